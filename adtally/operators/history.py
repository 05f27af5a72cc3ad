"""Dimensions that keep their history, and joins to the version of a day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.operators.fact import BROADCAST_LIMIT, join_side
from adtally.sources.sized import written

#: A version holds from the first day to the one before the second; null: it still holds.
VALID_FROM, VALID_TO = "valid_from", "valid_to"
#: Days that share a bucket of the point-in-time join.
BUCKET_DAYS = 32
_BUCKET = "_bucket"


def state(
    events: DataFrame,
    key: str,
    tracked: Sequence[str],
    newest_by: Sequence[str],
) -> DataFrame:
    """One row per member: its attributes on its newest event, ties to the larger attributes.

    An aggregate with map-side combine, so a member with many events sends a row per task.
    """
    attributes = F.struct(*tracked)
    newest = F.max(F.struct(*newest_by, attributes.alias("_attributes")))
    found = events.groupBy(key).agg(newest.alias("_newest"))
    return found.select(key, *[F.col(f"_newest._attributes.{c}").alias(c) for c in tracked])


def first_history(snapshot: DataFrame, key: str, tracked: Sequence[str], as_of: date) -> DataFrame:
    """All members of the snapshot, each with one version that holds from ``as_of``."""
    return snapshot.select(
        key, *tracked, F.lit(as_of).alias(VALID_FROM), F.lit(None).cast("date").alias(VALID_TO)
    )


def next_history(
    history: DataFrame, snapshot: DataFrame, key: str, tracked: Sequence[str], as_of: date
) -> DataFrame:
    """``history`` brought up to the state of ``as_of``.

    A changed member's version ends there and a new one begins; one that is gone ends, a new
    one begins, and what is equal (nulls too) stays open. A version that began on the same day
    is replaced, so a run can be repeated; one that began later is an error. Versions of a
    member never overlap. ``snapshot`` has one row per member.

    The open versions and the snapshot meet in one full outer join, where no member has more
    than two rows; closed versions are passed on.
    """
    is_open = F.col(VALID_TO).isNull()
    old = history.where(is_open).select(
        F.col(key).alias("_key"),
        F.struct(*tracked).alias("_was"),
        F.col(VALID_FROM).alias("_since"),
        F.lit(True).alias("_old"),
    )
    new = snapshot.select(
        F.col(key).alias("_member"), F.struct(*tracked).alias("_is"), F.lit(True).alias("_new")
    )
    met = old.join(new, F.col("_key").eqNullSafe(F.col("_member")), "full_outer")
    had, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    same = had & has & F.col("_was").eqNullSafe(F.col("_is"))
    day = F.lit(as_of)
    late = F.raise_error(F.lit(f"a version begins after {as_of}")).cast("boolean")

    def version(key_name: str, attributes: str, since: Column, to: Column) -> Column:
        fields = [F.col(f"{attributes}.{c}").alias(c) for c in tracked]
        return F.struct(
            F.col(key_name).alias(key), *fields, since.alias(VALID_FROM), to.alias(VALID_TO)
        )

    none = F.lit(None).cast("date")
    ends = had & ~same & F.when(F.col("_since") > day, late).otherwise(F.col("_since") < day)
    versions = F.array(
        F.when(same, version("_key", "_was", F.col("_since"), none)),
        F.when(ends, version("_key", "_was", F.col("_since"), day)),
        F.when(has & ~same, version("_member", "_is", day, none)),
    )
    following = met.select(F.explode(F.array_compact(versions)).alias("v")).select("v.*")
    return history.where(~is_open).unionByName(following)


def overlaps(history: DataFrame, key: str) -> DataFrame:
    """``(key, versions)`` of members with versions that overlap or are empty; should be none."""
    order = Window.partitionBy(key).orderBy(VALID_FROM, F.col(VALID_TO).asc_nulls_last())
    before = F.lag(F.coalesce(VALID_TO, F.lit(date(9999, 12, 31)))).over(order)
    bad = (before > F.col(VALID_FROM)) | (F.col(VALID_TO) <= F.col(VALID_FROM))
    return (
        history.withColumn("_bad", bad)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("versions"), F.max("_bad").alias("_bad"))
        .where("_bad")
        .drop("_bad")
    )


def attach_valid(
    events: DataFrame,
    history: DataFrame,
    key: str,
    columns: Sequence[str],
    day: str = "date",
    bucket_days: int = BUCKET_DAYS,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``events`` with ``columns`` of the version that held on the event's ``day``.

    An event without such a version keeps its row, with nulls. A range alone would need nested
    loops, and a member's versions would all meet its events; so days are put into buckets, a
    version goes to each bucket it touches (within the days that events have), and the join is
    one of equal members and buckets with the range as a further condition. A member with many
    events is spread over its buckets. The versions are broadcast if their measured size allows
    it; else both sides are shuffled, and adaptive execution splits what is still hot.
    """
    span = events.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()

    def bucket(column: Column) -> Column:
        return F.floor(F.unix_date(column) / bucket_days)

    last = F.least(F.coalesce(F.date_sub(VALID_TO, 1), F.lit(span["last"])), F.lit(span["last"]))
    first = F.greatest(F.col(VALID_FROM), F.lit(span["first"]))
    touched = history.where(first <= last).select(
        F.col(key).alias("_member"),
        *[F.col(c).alias(f"_v_{c}") for c in columns],
        VALID_FROM,
        VALID_TO,
        F.explode(F.sequence(bucket(first), bucket(last))).alias(_BUCKET),
    )
    side = join_side(written(touched, "versions_by_bucket"), limit)
    held = (F.col(VALID_FROM) <= F.col(day)) & (
        F.col(VALID_TO).isNull() | (F.col(day) < F.col(VALID_TO))
    )
    at = events.withColumn("_at", bucket(F.col(day)))
    joined = at.join(
        side,
        (F.col(key) == F.col("_member")) & (F.col("_at") == F.col(_BUCKET)) & held,
        "left",
    )
    return joined.select(*events.columns, *[F.col(f"_v_{c}").alias(c) for c in columns])
