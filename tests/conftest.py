from __future__ import annotations

import os
import sys
from datetime import date, datetime
from uuid import uuid4

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adtally.plans.publish import Lake  # noqa: E402
from adtally.session import local_session, shared_folder  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUN_TS = datetime(2026, 3, 1, 6, 0, 0)
RUN_DATE = date(2026, 3, 1)

EVENT_TEXT = (
    "merchant_id STRING, campaign_id STRING, market STRING, date DATE, spend DOUBLE, "
    "impressions BIGINT, clicks BIGINT, ingestion_ts TIMESTAMP"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lake(spark):
    tag = uuid4().hex[:12]
    made = Lake(shared_folder(spark), bronze=f"b_{tag}", silver=f"s_{tag}", gold=f"g_{tag}")
    made.prepare(spark)
    return made


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def change(**settings):
        for key, value in settings.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def events(spark):
    """Rows under the silver columns; fields not given take the values of a good row."""
    good = {
        "merchant_id": "m1",
        "campaign_id": "c1",
        "market": "DE",
        "date": date(2026, 1, 1),
        "spend": 1.0,
        "impressions": 10,
        "clicks": 2,
        "ingestion_ts": datetime(2026, 1, 2, 3, 0, 0),
    }

    def make(*rows):
        return spark.createDataFrame(
            [tuple({**good, **row}.values()) for row in rows], EVENT_TEXT
        )

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df) -> str:
    """The plan after adaptive execution ran it."""
    df.collect()
    return plan_of(df)
