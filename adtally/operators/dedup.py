"""Keep the newest version of each event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.sources.contracts import EVENT_KEY, INGESTED_AT

_RANK = "_recency"


def dedup_latest(
    df: DataFrame,
    keys: Sequence[str] = EVENT_KEY,
    newest_by: str = INGESTED_AT.name,
    tie_breakers: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: the one with the latest ``newest_by``.

    A batch shares one ingestion time, so ties are the rule inside a batch. They are
    settled by ``tie_breakers``, by default all other columns in order: rows that still
    tie are then equal, and the result does not depend on the layout of the input.

    Spark applies the rank limit before the shuffle as well (``WindowGroupLimit``), so a
    key that holds a large share of all rows sends one row per map task. The price is a
    sort on either side of the shuffle; with the key's hash in front, nearly every
    comparison ends on one long instead of on texts with common beginnings.
    """
    if tie_breakers is None:
        tie_breakers = [c for c in df.columns if c not in keys and c != newest_by]
    newest_first = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(
        *[F.col(c).desc_nulls_last() for c in (newest_by, *tie_breakers)]
    )
    return (
        df.withColumn(_RANK, F.row_number().over(newest_first))
        .where(F.col(_RANK) == 1)
        .drop(_RANK)
    )


def dedup_audit(
    df: DataFrame, keys: Sequence[str] = EVENT_KEY, newest_by: str = INGESTED_AT.name
) -> DataFrame:
    """``(keys, copies, won_by)`` of each key that has several rows: the time that wins."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), F.max(newest_by).alias("won_by"))
        .where("copies > 1")
    )


def dedup_stats(df: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Rows, distinct keys and the duplicates a dedup would drop, in one pass.

    Only per-key counts are shuffled; null keys count as a key, as they do in the window.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("key_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_dropped"),
    )
