"""The given tables, and adapters that map them to campaign events.

The given data breaks few rules by itself, so the adapters overwrite some measures by
fixed residues of the row id. Every row stays in; only values change.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}

#: Campaign events out of ``events``; spend and impressions carry faults.
EVENT_COLUMNS = {
    "merchant_id": "CAST(user_id AS STRING)",
    "campaign_id": "get_json_object(props, '$.k')",
    "market": "event_type",
    "date": "CAST(ts AS DATE)",
    "spend": "CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN -value "
    "ELSE value END",
    "impressions": "CAST(IF(event_id % 53 = 0, 0, event_id % 100) AS INT)",
    "clicks": "CAST(event_id % 7 AS INT)",
    "ingestion_ts": "CAST(ts AS TIMESTAMP)",
}

#: Missing ids, days, markets and measures on top, so that every default rule fires.
MISSING_VALUES = EVENT_COLUMNS | {
    "merchant_id": "IF(event_id % 59 = 0, NULL, CAST(user_id AS STRING))",
    "campaign_id": "IF(event_id % 61 = 0, NULL, get_json_object(props, '$.k'))",
    "market": "IF(event_id % 71 = 0, NULL, event_type)",
    "date": "IF(event_id % 67 = 0, NULL, CAST(ts AS DATE))",
    "impressions": "CAST(CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 0 "
    "ELSE event_id % 100 END AS INT)",
    "clicks": "CAST(IF(event_id % 47 = 0, NULL, event_id % 7) AS INT)",
    "ingestion_ts": "IF(event_id % 73 = 0, NULL, CAST(ts AS TIMESTAMP))",
}

#: Faults that only the strict rules catch.
STRICT_FAULTS = MISSING_VALUES | {
    "spend": "CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 79 = 0 "
    "THEN CAST('NaN' AS DOUBLE) ELSE value END",
    "impressions": "CAST(IF(event_id % 83 = 0, -5, event_id % 100) AS INT)",
    "clicks": "CAST(IF(event_id % 89 = 0, -1, event_id % 7) AS INT)",
}

#: All columns as text, some of it unreadable.
TEXT_COLUMNS = {
    "merchant_id": "CAST(user_id AS STRING)",
    "campaign_id": "get_json_object(props, '$.k')",
    "market": "event_type",
    "date": "IF(event_id % 43 = 0, '2026-13-45', CAST(CAST(ts AS DATE) AS STRING))",
    "spend": "IF(event_id % 37 = 0, 'abc', CAST(value AS STRING))",
    "impressions": "CASE WHEN event_id % 47 = 0 THEN 'x1' WHEN event_id % 53 = 0 THEN '' "
    "ELSE CAST(event_id % 100 AS STRING) END",
    "clicks": "IF(event_id % 61 = 0, '99999999999999999999', CAST(event_id % 7 AS STRING))",
    "ingestion_ts": "IF(event_id % 59 = 0, 'not a time', CAST(ts AS STRING))",
}

#: Events that are sent once more, later: with other spend, and some from another market.
RESENT = EVENT_COLUMNS | {
    "market": "IF(user_id % 10 = 0, 'view', event_type)",
    "spend": "CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN -value "
    "ELSE value + 1 END",
    "ingestion_ts": "TIMESTAMP '2024-02-01 06:00:00'",
}

#: Campaign events out of ``lineitem`` and the supplier's region.
LINEITEM_COLUMNS = {
    "merchant_id": "CAST(l_suppkey AS STRING)",
    "campaign_id": "CAST(l_partkey AS STRING)",
    "market": "r_name",
    "date": "CAST(l_shipdate AS DATE)",
    "spend": "l_extendedprice",
    "impressions": "CAST(l_quantity AS INT)",
    "clicks": "l_linenumber",
}


def read_given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def campaign_events(
    spark: SparkSession, sf_dir: str, columns: Mapping[str, str] = EVENT_COLUMNS
) -> DataFrame:
    return _project(read_given(spark, sf_dir, "events"), columns)


def shipped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaign of each line item alone, which needs no other table."""
    lines = read_given(spark, sf_dir, "lineitem")
    return _project(lines, {"campaign_id": LINEITEM_COLUMNS["campaign_id"]})


def shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a campaign event; the join sides are left to Catalyst."""
    places = (
        read_given(spark, sf_dir, "supplier")
        .join(read_given(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(read_given(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    lines = read_given(spark, sf_dir, "lineitem")
    return _project(lines.join(places, lines.l_suppkey == places.s_suppkey), LINEITEM_COLUMNS)
