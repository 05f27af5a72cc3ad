"""Rows in one global order, each with the row that follows it, without one task for all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a range should hold as long as there are not more than so many ranges, and rows
#: that it should hold beyond.
RANGE_ROWS, SMALL_RANGES, FULL_ROWS = 2_000, 1_024, 100_000


def ranges_for(count: int, rows: int) -> int:
    """How many ranges ``count`` rows are dealt to; there is no most number."""
    return max(1, count // FULL_ROWS, min(SMALL_RANGES, count // rows))


def constants(values: list, kind: str) -> Column:
    """An array constant; its elements are one literal together, not one each."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def limits_up_to(limits: list[float], place: Column) -> Column:
    """How many of the ascending ``limits`` are at most ``place``, by binary search; null: 0."""
    if not limits:
        return F.lit(0)
    held = constants(limits, "double")
    steps = [1 << i for i in reversed(range(len(limits).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        # Beyond the last limit there is a null, which is not passed.
        return F.when(F.get(held, at + step - 1) <= place, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def in_ranges(df: DataFrame, key: str, order: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``range_no`` and ``ghost``, each task holding whole ranges in order.

    Rows are ordered by ``key`` (nulls first), then by ``order``. Every range ends with the
    first row of the next one as a ghost, and the last range with the first row of all, so
    that a task finds the follower of each of its rows. Only two numbers for each range, its
    limit and its first key, pass through the driver. Rows of one key are in one range.
    """
    place = F.col(key).cast("double")
    count = df.select(key).count()
    parts = ranges_for(count, rows)
    shares = [i / parts for i in range(1, parts)]
    places = df.select(place.alias("place"))
    limits = sorted(set(places.approxQuantile("place", shares, 0.2 / parts))) if shares else []
    dealt = df.withColumn("range_no", limits_up_to(limits, place))
    firsts = {
        r.range_no: None if r.nulls else r.first_key
        for r in dealt.groupBy("range_no")
        .agg(F.min(key).alias("first_key"), F.count_if(F.col(key).isNull()).alias("nulls"))
        .collect()
    }
    used = sorted(firsts)
    first_keys = [firsts.get(i) for i in range(max(used, default=0) + 1)]
    earlier = {b: used[i - 1] for i, b in enumerate(used)}
    before = [earlier.get(i, 0) for i in range(len(first_keys))]
    at = F.col("range_no") + 1
    first_key = F.element_at(constants(first_keys, "bigint"), at)
    own = F.struct(F.col("range_no"), F.lit(False).alias("ghost"))
    ghost = F.struct(
        F.element_at(constants(before, "int"), at).alias("range_no"), F.lit(True).alias("ghost")
    )
    seats = F.when(F.col(key).eqNullSafe(first_key), F.array(own, ghost)).otherwise(F.array(own))
    return (
        dealt.withColumn("seat", F.explode(seats))
        .withColumns({"range_no": F.col("seat.range_no"), "ghost": F.col("seat.ghost")})
        .drop("seat")
        .repartitionByRange(max(1, len(used)), "range_no")
        .sortWithinPartitions("range_no", "ghost", F.col(key).asc_nulls_first(), *order)
    )
