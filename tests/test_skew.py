"""The queries on tables where one key holds a third of the rows, and on empty ones."""

from __future__ import annotations

import glob
import os

import oracle
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_file

QUERIES = entry_file.queries()
SQL = entry_file.oracle_sql()

HOT_EVENTS = """
SELECT event_id,
       CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-15 12:00:00' ELSE ts END AS ts,
       CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
       CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type,
       value,
       CASE WHEN event_id % 3 = 0 THEN '{"k": 5}' ELSE props END AS props
FROM events"""

HOT_LINES = """
SELECT * REPLACE (
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey,
  CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE l_partkey END AS l_partkey,
  CASE WHEN l_orderkey % 3 = 0 THEN TIMESTAMP '1996-06-01' ELSE l_shipdate END AS l_shipdate)
FROM lineitem"""


def _derive(folder, **changed: str) -> str:
    """The given tables in a folder, some of them replaced by a query over them."""
    con = oracle.connect(SF_DIR)
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        if table in changed:
            con.execute(
                f"COPY ({changed[table]}) TO '{folder}/{table}.parquet' (ROW_GROUP_SIZE 2048)"
            )
        else:
            os.symlink(path, f"{folder}/{table}.parquet")
    con.close()
    return str(folder)


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    return _derive(tmp_path_factory.mktemp("hot"), events=HOT_EVENTS, lineitem=HOT_LINES)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return _derive(
        tmp_path_factory.mktemp("empty"),
        events="SELECT * FROM events WHERE false",
        lineitem="SELECT * FROM lineitem WHERE false",
    )


@pytest.fixture
def eager_skew_handling(conf):
    """Thresholds so low that test data is treated as skewed."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="8KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
    )


@pytest.mark.parametrize(
    "name",
    [
        "events_by_market",
        "distinct_counts",
        "rejects_by_reason",
        "rejects_by_reason_strict",
        "dedup_latest",
        "dedup_latest_by_grain",
        "dedup_latest_tied",
        "dedup_latest_shipped",
        "dedup_stats",
        "dim_merchant",
        "dim_campaign_part",
        "fact_join_merchant",
        "fact_campaign_daily",
        "fact_campaign_daily_sql",
        "fact_campaign_daily_shipped",
        "dq_relationships",
        "dq_report",
        "sink_bronze_roundtrip",
        "sink_silver_roundtrip",
        "layer_counts",
    ],
)
def test_hot_keys_keep_results_whole(spark, hot, eager_skew_handling, name):
    con = oracle.connect(hot)
    assert oracle.differences(QUERIES[name](spark, hot), con, SQL[name]) is None
    con.close()


@pytest.mark.parametrize(
    "name",
    ["silver_events", "fact_campaign_daily", "fact_campaign_daily_sql", "sink_rejected_roundtrip"],
)
def test_no_events_give_an_empty_result(spark, empty, name):
    got = QUERIES[name](spark, empty)
    assert got.isEmpty()
    assert got.columns == QUERIES[name](spark, SF_DIR).columns


def test_no_events_count_as_zero(spark, empty):
    assert {r.row_count for r in QUERIES["layer_counts"](spark, empty).collect()} == {0}
    assert {r.failures for r in QUERIES["dq_report"](spark, empty).collect()} == {0}
    assert QUERIES["dedup_stats"](spark, empty).first() == (0, 0, 0)
