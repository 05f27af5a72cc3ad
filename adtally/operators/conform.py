"""Fit a frame to a strict contract."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adtally.functions.literals import timestamp
from adtally.sources.contracts import SILVER, UNKNOWN_DATE, UNKNOWN_PARTITION, UNKNOWN_TEXT


class SchemaMismatch(ValueError):
    """A frame does not have exactly the schema its table declares."""


def silver_defaults(ingested_at: datetime, market: str = UNKNOWN_TEXT) -> dict[str, Column]:
    """Stand-ins for nulls in the required columns.

    All are uncast literals: a cast would leave the column marked nullable.
    """
    return {
        "merchant_id": F.lit(UNKNOWN_TEXT),
        "campaign_id": F.lit(UNKNOWN_TEXT),
        "market": F.lit(market),
        "date": F.lit(UNKNOWN_DATE),
        "ingestion_ts": timestamp(ingested_at),
    }


def fill_required(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Replace nulls by the defaults; the columns are non-null from here on."""
    return df.withColumns({name: F.coalesce(F.col(name), v) for name, v in defaults.items()})


def named_market(df: DataFrame) -> DataFrame:
    """An empty market under the name of a missing one; a null stays one."""
    market = F.col("market")
    return df.withColumn(
        "market", F.when(market == UNKNOWN_TEXT, UNKNOWN_PARTITION).otherwise(market)
    )


def conform(
    df: DataFrame, defaults: Mapping[str, Column], schema: StructType = SILVER
) -> DataFrame:
    """Reorder, drop extras and widen to ``schema``; an unsafe change is an error."""
    return fill_required(df, defaults).to(schema)


def require_schema(df: DataFrame, schema: StructType, nulls: bool = True) -> DataFrame:
    """``df`` itself if names, order, types and (with ``nulls``) null flags equal ``schema``.

    Parquet does not refuse a changed schema on overwrite, so strict tables are guarded
    here, before a byte is written.
    """
    have, want = (
        [(f.name, f.dataType, f.nullable if nulls else None) for f in s.fields]
        for s in (df.schema, schema)
    )
    if have != want:
        surplus = [h for h in have if h not in want]
        lacking = [w for w in want if w not in have]
        raise SchemaMismatch(
            f"expected {schema.simpleString()}, got {df.schema.simpleString()}; "
            f"not declared: {surplus}, not found: {lacking}"
        )
    return df
