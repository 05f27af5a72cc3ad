"""A late batch merged into silver: only the directories that it touches are written."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.functions.rules import DEFAULT_RULES, Rule
from adtally.operators.conform import conform, silver_defaults
from adtally.operators.dedup import dedup_latest
from adtally.plans.publish import Lake
from adtally.plans.silver import refine
from adtally.sources import versions
from adtally.sources.contracts import EVENT_KEY, SILVER, UNKNOWN_PARTITION
from adtally.sources.quarantine import write_rejected
from adtally.sources.sinks import overwrite_table, replace_directories
from adtally.sources.sized import written
from adtally.sources.tables import read_table

#: The directories of silver.
LAYOUT = ("market", "date")

Place = tuple[str, date]


class Merged(NamedTuple):
    rows: int  # written to the touched directories
    rejected: int
    touched: frozenset[Place]


def _places(df: DataFrame) -> set[Place]:
    """The directories of the rows: as many values as the table has directories at most."""
    return {(r.market, r.date) for r in df.select(*LAYOUT).distinct().collect()}


def _within(places: Iterable[Place]) -> Column:
    """A filter on directories alone, which prunes the scan."""
    days: dict[str, list[date]] = {}
    for market, day in sorted(places):
        days.setdefault(market, []).append(day)
    each = [(F.col("market") == m) & F.col("date").isin(d) for m, d in days.items()]
    return reduce(or_, each, F.lit(False))


def latest_of(rows: DataFrame, run_ts: datetime, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """One row per key out of silver rows, as ``refine`` would choose them: the stand-in of a
    missing market sorts like a missing one."""
    named = rows.withColumn("market", F.nullif("market", F.lit(UNKNOWN_PARTITION)))
    return conform(dedup_latest(named, keys), silver_defaults(run_ts, UNKNOWN_PARTITION))


def merge_silver(
    batch: DataFrame,
    lake: Lake,
    run_ts: datetime,
    run_id: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    keys: Sequence[str] = EVENT_KEY,
) -> Merged:
    """Merge a batch of bronze rows into silver; its rejects go to the quarantine.

    The result is that of one rebuild over all batches: the newest version of each key wins,
    whichever batch brought it, since the latest of the latest is the latest of all. Rows
    without an ingestion time take that of their own run.

    A key need not stay in its directory: the market is no part of it. Touched are thus the
    directories of the batch, and those where silver has one of its keys. Where the day is part
    of the key, only the batch's days are searched. The touched directories are read, merged
    and written; all others pass to the next version as they are. Equal keys are met by a
    shuffle of unique keys on either side, so that no key is hot.
    """
    spark = batch.sparkSession
    fresh, bad = refine(batch, run_ts, rules, keys)
    rejects = write_rejected(bad, lake.rejected_path, run_id, lake.fmt, lake.rejected_table).rows
    fresh = conform(
        written(fresh, "batch").table, silver_defaults(run_ts, UNKNOWN_PARTITION)
    )
    own = _places(fresh)
    version = versions.current_version(spark, lake.silver_events)
    if version is None:
        size = overwrite_table(fresh, lake.silver_events, LAYOUT, SILVER, lake.fmt)
        return Merged(size.rows, rejects, frozenset(own))
    silver = read_table(spark, lake.silver_events, SILVER)
    searched = silver
    if "date" in keys:
        searched = silver.where(F.col("date").isin(sorted({day for _, day in own})))
    touched = own | _places(searched.join(fresh.select(*keys), list(keys), "left_semi"))
    old = silver.where(_within(touched))
    names = [
        name
        for name in versions.directories(spark, version, LAYOUT)
        if _place(name) in touched
    ]
    merged = latest_of(old.unionByName(fresh), run_ts, keys)
    size = replace_directories(merged, lake.silver_events, LAYOUT, names, SILVER, lake.fmt)
    return Merged(size.rows, rejects, frozenset(touched))


def _place(directory: str) -> Place:
    market, day = versions.values_of(directory)
    return market, date.fromisoformat(day)
