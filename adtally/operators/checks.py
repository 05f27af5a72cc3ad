"""Declared data tests as aggregates: how many failures per table and column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.sources.sized import written


class Check(NamedTuple):
    kind: str  # "not_null", "unique" or "relationships"
    table: str
    column: str
    parent: str | None = None
    parent_column: str | None = None


# --- Fixed values: the tests declared on the gold tables ------------------------------
GOLD_CHECKS = (
    Check("unique", "dim_merchant", "merchant_key"),
    Check("not_null", "dim_merchant", "merchant_key"),
    Check("unique", "dim_merchant", "merchant_id"),
    Check("not_null", "dim_merchant", "merchant_id"),
    Check("unique", "dim_market", "market_key"),
    Check("not_null", "dim_market", "market_key"),
    Check("unique", "dim_market", "market"),
    Check("not_null", "dim_market", "market"),
    Check("not_null", "fact_campaign_daily", "merchant_key"),
    Check("relationships", "fact_campaign_daily", "merchant_key", "dim_merchant", "merchant_key"),
    Check("not_null", "fact_campaign_daily", "market_key"),
    Check("relationships", "fact_campaign_daily", "market_key", "dim_market", "market_key"),
    Check("not_null", "fact_campaign_daily", "ctr"),
    Check("not_null", "fact_campaign_daily", "cost_per_click"),
)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, failures)``: nulls per column, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "failures")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """``(value, copies)``: non-null values that occur more than once."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def orphans(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """``(value, row_count)``: non-null child keys that no parent row has.

    The child is counted per key first, so a key with many rows is one row at the join.
    """
    keys = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return keys.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def profile(
    table: DataFrame, checks: Sequence[Check], parents: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One pass over ``table``: rows per combination of its key columns (and of ``by``), and
    the nulls of the other columns in question."""
    keyed = [c.column for c in checks if c.kind != "not_null"]
    keys = list(dict.fromkeys([*keyed, *parents, *by]))
    others = [c.column for c in checks if c.kind == "not_null" and c.column not in keys]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in others]
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *nulls)


def wanted_of(checks: Sequence[Check], table: str) -> tuple[list[Check], list[str]]:
    """The checks on a table, and its columns that checks on other tables refer to."""
    own = [c for c in checks if c.table == table]
    return own, [c.parent_column for c in checks if c.parent == table]


def _nulls_in(profile: DataFrame, column: str) -> Column:
    if column in profile.columns:
        counted = F.sum(F.when(F.col(column).isNull(), F.col("_rows")))
    else:
        counted = F.sum(f"_null_{column}")
    return F.coalesce(counted, F.lit(0))


def run_checks(
    tables: Mapping[str, DataFrame],
    checks: Sequence[Check],
    known: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """``(check, table_name, column_name, failures)``, one row per check.

    Failures are null rows, repeated values, and child rows without a parent. Each table is
    read once, however many checks it has; they work on its profile, which is written for them.
    A table whose profile is ``known`` is not read at all.
    """
    for c in checks:
        if c.kind not in ("not_null", "unique", "relationships"):
            raise ValueError(f"unknown check {c.kind!r}")
    names = dict.fromkeys([c.table for c in checks] + [c.parent for c in checks if c.parent])
    profiles = dict(known or {})
    for name in names:
        if name not in profiles:
            made = profile(tables[name], *wanted_of(checks, name))
            profiles[name] = written(made, "profile").table

    def labelled(kind: str, table: str, failures: DataFrame) -> DataFrame:
        return failures.select(
            F.lit(kind).alias("check"), F.lit(table).alias("table_name"), "column_name", "failures"
        )

    parts = []
    for table in dict.fromkeys(c.table for c in checks if c.kind == "not_null"):
        columns = [c.column for c in checks if c.kind == "not_null" and c.table == table]
        own = profiles[table]
        counted = own.agg(*[_nulls_in(own, c).alias(c) for c in columns])
        parts.append(
            labelled("not_null", table, counted.unpivot([], columns, "column_name", "failures"))
        )
    for c in checks:
        rows = profiles[c.table].where(F.col(c.column).isNotNull()) if c.kind != "not_null" else None
        if c.kind == "unique":
            copies = rows.groupBy(c.column).agg(F.sum("_rows").alias("copies"))
            bad = copies.where("copies > 1").agg(F.count(F.lit(1)).alias("failures"))
        elif c.kind == "relationships":
            parent = profiles[c.parent].select(F.col(c.parent_column).alias(c.column))
            lost = rows.select(c.column, "_rows").join(parent, c.column, "left_anti")
            bad = lost.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("failures"))
        else:
            continue
        parts.append(labelled(c.kind, c.table, bad.withColumn("column_name", F.lit(c.column))))
    return reduce(DataFrame.unionAll, parts)
