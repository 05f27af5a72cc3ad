"""Dimensions: distinct members with dense surrogate keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.sources.sized import Sized, written

# monotonically_increasing_id() puts the task number above this bit and the row's
# position inside the task below it.
_POSITION_BITS = 33
_SEAT = "_seat"
_BLOCK = "_block"
_BEFORE = "_rows_before"


def distinct_members(df: DataFrame, natural_key: str) -> DataFrame:
    """Each value once; duplicates are removed before the shuffle, then after it."""
    return df.select(natural_key).distinct()


def dense_keys(members: DataFrame, natural_key: str, key_name: str) -> Sized:
    """Number distinct members 1..n in the order of ``natural_key``, nulls last.

    Equal to ``row_number() OVER (ORDER BY natural_key)`` without its single task:
    members are split into ordered ranges, each row's seat in its range is written down
    once, and a key is the seat plus the members in all earlier ranges. The written table
    freezes the ranges, whose bounds come from a sample and could move if computed twice.
    Its observed size is that of the result: two columns, the members and a number.
    """
    order = F.col(natural_key).asc_nulls_last()
    seated, size = written(
        members.repartitionByRange(order)
        .sortWithinPartitions(order)
        .withColumn(_SEAT, F.monotonically_increasing_id()),
        "seated_members",
    )
    block = F.shiftright(_SEAT, _POSITION_BITS)
    earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so at most as many as there are shuffle partitions: small
    # enough for one task and a broadcast at any data size.
    blocks = (
        seated.groupBy(block.alias(_BLOCK))
        .agg(F.count(F.lit(1)).alias("size"))
        .select(_BLOCK, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(_BEFORE))
    )
    position = F.col(_SEAT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    numbered = (
        seated.withColumn(_BLOCK, block)
        .join(F.broadcast(blocks), _BLOCK)
        .select((F.col(_BEFORE) + position + 1).alias(key_name), natural_key)
    )
    return Sized(numbered, size)


def build_dim(df: DataFrame, natural_key: str, key_name: str, effective: date) -> Sized:
    """Surrogate key, natural key and effective date, one row per member of ``df``."""
    numbered, size = dense_keys(distinct_members(df, natural_key), natural_key, key_name)
    dim = numbered.select(key_name, natural_key, F.lit(effective).alias("effective_date"))
    return Sized(dim, size)


def extend_dim(
    known: Sized, df: DataFrame, natural_key: str, key_name: str, effective: date
) -> Sized:
    """``known`` with the members of ``df`` that it lacks; those it has keep key and date.

    New members are numbered in their order above the largest key in use, so keys never
    change and are never given twice, though after some runs they no longer follow the order
    of all members. The anti-join meets distinct members on either side. Members that are gone
    stay: facts of former runs may refer to them.
    """
    members, have = distinct_members(df, natural_key), known.table.select(natural_key)
    same = F.col("_new").eqNullSafe(F.col(natural_key))
    lacking = (
        members.select(F.col(natural_key).alias("_new"))
        .join(have, same, "left_anti")
        .select(F.col("_new").alias(natural_key))
    )
    numbered, size = dense_keys(lacking, natural_key, key_name)
    largest = known.table.agg(F.max(key_name)).first()[0] or 0
    added = numbered.select(
        (F.col(key_name) + largest).alias(key_name),
        natural_key,
        F.lit(effective).alias("effective_date"),
    )
    return Sized(known.table.select(*added.columns).unionAll(added), known.size.plus(size))
