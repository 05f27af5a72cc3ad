"""Joins that set hot keys apart by themselves, whatever adaptive execution is set to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.sources.sized import written

#: A key is hot if it holds at least this share of the rows: so at most 1,000 keys are.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """``(key)`` of the non-null keys that hold ``share`` of the rows; ``1 / share`` at most.

    Counted over all rows, with map-side combine; the counts are stored, since their sum is
    needed as well.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    counts = written(counts, "rows_by_key").table
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    hot = (F.col("_rows") >= max(1.0, share * total)) & F.col(key).isNotNull()
    return counts.where(hot).select(key)


def join_isolated(
    left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE
) -> DataFrame:
    """Inner equi-join of many rows with a dimension, one row per key at most on the right.

    Rows of hot keys stay where they are and meet the few dimension rows of those keys in a
    broadcast, which ``1 / share`` bounds; all others are shuffled, and no key among them has
    more than ``share`` of the rows. Both parts scan ``left``, so it should be a table.
    """
    hot = hot_keys(left, key, share)
    few = F.broadcast(hot)
    members = right.join(few, key, "left_semi")
    isolated = left.join(F.broadcast(members), key)
    rest = left.join(few, key, "left_anti").join(right.hint("merge"), key)
    return isolated.unionByName(rest)
