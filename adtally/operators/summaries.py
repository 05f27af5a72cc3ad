"""Counts and previews over a layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.functions.metrics import cost_per_click, ctr
from adtally.sources.contracts import REASON


def rows_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column: ``n_<column>`` in one row."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])


def partitions_in_use(df: DataFrame) -> DataFrame:
    """How many tasks hold rows of ``df``; asks the plan, not an RDD."""
    return df.select(F.spark_partition_id().alias("pid")).agg(
        F.count_distinct("pid").alias("partition_count")
    )


def kept_together(df: DataFrame, column: str) -> DataFrame:
    """``(column, row_count, partition_count)``: over how many tasks each value is spread."""
    placed = df.select(column, F.spark_partition_id().alias("_task"))
    return placed.groupBy(column).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("_task").alias("partition_count"),
    )


def reject_rates(flagged: DataFrame, day: str = "date") -> DataFrame:
    """Rows per day and reason, and their share of the day; no reason is a reason too.

    Counts are joined to counts: nothing wider than a day's reasons meets in one place.
    """
    counts = flagged.groupBy(day, REASON).agg(F.count(F.lit(1)).alias("row_count"))
    totals = counts.groupBy(F.col(day).alias("_day")).agg(F.sum("row_count").alias("_rows"))
    return counts.join(totals, F.col(day).eqNullSafe(F.col("_day"))).select(
        day, REASON, "row_count", F.round(F.col("row_count") / F.col("_rows"), 6).alias("share")
    )


def daily_rollup(events: DataFrame, *by: str) -> DataFrame:
    """Measures summed per day and ``by``, with the ratios of the sums.

    Spend is added as a decimal: a sum of doubles depends on the order of the rows. A group
    with spend that is not a number, or too large for the decimal, has no number for a sum.
    """
    exact = F.expr("try_cast(spend AS DECIMAL(28, 6))")
    odd = F.max(F.col("spend").isNotNull() & exact.isNull())
    sums = events.groupBy("date", *by).agg(
        F.when(odd, F.lit(float("nan"))).otherwise(F.sum(exact).cast("double")).alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
    )
    return sums.select(
        "date",
        *by,
        "spend",
        "impressions",
        "clicks",
        ctr(),
        cost_per_click(),
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in a total order; each task keeps only its own ``n``."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(n)
