"""Declared schemas of the layers, and their fixed values."""

from __future__ import annotations

from datetime import date

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# --- Fixed values: column names, types and null flags of the layers -------------------

#: The columns that every landed batch must have.
SOURCE = StructType(
    [
        StructField("merchant_id", StringType(), False),
        StructField("campaign_id", StringType(), False),
        StructField("market", StringType(), False),
        StructField("date", DateType(), False),
        StructField("spend", DoubleType(), True),
        StructField("impressions", IntegerType(), True),
        StructField("clicks", IntegerType(), True),
    ]
)

#: When a batch was taken in. ``ingest`` sets it, over any value that is there already.
INGESTED_AT = StructField("ingestion_ts", TimestampType(), False)

BRONZE = StructType([*SOURCE.fields, INGESTED_AT])

#: Counts are widened to 64 bits on the way from bronze to silver.
SILVER = StructType(
    [
        StructField("merchant_id", StringType(), False),
        StructField("campaign_id", StringType(), False),
        StructField("market", StringType(), False),
        StructField("date", DateType(), False),
        StructField("spend", DoubleType(), True),
        StructField("impressions", LongType(), True),
        StructField("clicks", LongType(), True),
        INGESTED_AT,
    ]
)

#: The star. Keys are always there; a ratio is null where its measure is.
DIM_MERCHANT = StructType(
    [
        StructField("merchant_key", LongType(), False),
        StructField("merchant_id", StringType(), False),
        StructField("effective_date", DateType(), False),
    ]
)
DIM_MARKET = StructType(
    [
        StructField("market_key", LongType(), False),
        StructField("market", StringType(), False),
        StructField("effective_date", DateType(), False),
    ]
)
FACT_CAMPAIGN_DAILY = StructType(
    [
        StructField("merchant_key", LongType(), False),
        StructField("market_key", LongType(), False),
        StructField("campaign_id", StringType(), False),
        StructField("date", DateType(), False),
        StructField("spend", DoubleType(), True),
        StructField("impressions", LongType(), True),
        StructField("clicks", LongType(), True),
        StructField("ctr", DoubleType(), True),
        StructField("cost_per_click", DoubleType(), True),
    ]
)

#: Columns the quarantine adds to the silver ones.
REASON = "_rejection_reason"
QUARANTINED_AT = "_quarantined_at"

#: Metadata of that column: the batch's time in microseconds, there without any row too.
BATCH_TIME = "batch_time"

#: One event per merchant, campaign and day; the documented grain also has the market.
EVENT_KEY = ("merchant_id", "campaign_id", "date")
EVENT_GRAIN = (*EVENT_KEY, "market")

#: Stand-ins for nulls in required columns.
UNKNOWN_TEXT = ""
UNKNOWN_DATE = date(1970, 1, 1)

#: The market of events that have none: the market names directories, where an empty value
#: would read back as null, and an inner join would then lose the row.
UNKNOWN_PARTITION = "__unknown__"
