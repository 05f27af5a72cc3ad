"""The gold layer as Spark SQL over whatever frames stand for its sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from adtally.functions.metrics import COST_PER_CLICK, CTR
from adtally.operators.dimensions import dense_keys
from adtally.operators.fact import BROADCAST_LIMIT, EVENT_COLUMNS, join_side
from adtally.plans.gold import Star
from adtally.sources.sized import Sized, written

MEMBERS = "SELECT DISTINCT {column} FROM {events}"

DIMENSION = """
SELECT {key}, {column}, :effective AS effective_date
FROM {members}
"""

FACT = f"""
WITH keyed AS (
  SELECT * FROM {{events}} JOIN {{merchants}} USING (merchant_id) JOIN {{markets}} USING (market)
)
SELECT merchant_key, market_key, campaign_id, `date`, spend, impressions, clicks,
       {CTR} AS ctr, {COST_PER_CLICK} AS cost_per_click
FROM keyed
"""


def dimension(events: DataFrame, column: str, key: str, effective: date) -> Sized:
    """A dimension by SQL; the numbering in between runs over ordered ranges, since
    ``row_number() OVER (ORDER BY ...)`` would put all members into one task."""
    spark = events.sparkSession
    members = spark.sql(MEMBERS, events=events, column=events[column])
    numbered, size = dense_keys(members, column, key)
    dim = spark.sql(
        DIMENSION,
        args={"effective": effective},
        members=numbered,
        key=numbered[key],
        column=numbered[column],
    )
    return Sized(dim, size)


def star(events: DataFrame, run_date: date, limit: int = BROADCAST_LIMIT) -> Star:
    """The same star as ``plans.gold.star``, from SQL text."""
    events = written(events.select(*EVENT_COLUMNS), "events").table
    merchants = dimension(events, "merchant_id", "merchant_key", run_date)
    markets = dimension(events, "market", "market_key", run_date)
    fact = events.sparkSession.sql(
        FACT,
        events=events,
        merchants=join_side(merchants, limit),
        markets=join_side(markets, limit),
    )
    return Star(merchants.table, markets.table, fact)
