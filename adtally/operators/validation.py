"""Rule validation and the clean / rejected split."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.functions.literals import micros, timestamp
from adtally.functions.rules import DEFAULT_RULES, Rule, all_kept, any_broken, reason
from adtally.sources.contracts import BATCH_TIME, QUARANTINED_AT, REASON


def flag(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """One ``_fail_<reason>`` column per rule, and the joined reason."""
    return df.select("*", *[rule.flag() for rule in rules], reason(rules).alias(REASON))


def clean(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rows that break no rule, with the columns they came with."""
    return df.where(all_kept(rules))


def rejected(
    df: DataFrame, quarantined_at: datetime, rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Rows that break a rule, with their reason and the time of quarantine.

    The time's column carries it as metadata too, so that an empty batch has one.
    """
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    stated = {BATCH_TIME: micros(quarantined_at, zone)}
    return df.where(any_broken(rules)).select(
        "*",
        reason(rules).alias(REASON),
        timestamp(quarantined_at).alias(QUARANTINED_AT, metadata=stated),
    )


def split(
    df: DataFrame, quarantined_at: datetime, rules: Sequence[Rule] = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """``(clean, rejected)``: every row of ``df`` is in exactly one of them.

    Both are map-only scans of ``df``. At volume a second pruned scan costs less than
    keeping the whole validated input in memory or on disk between the two writes.
    """
    return clean(df, rules), rejected(df, quarantined_at, rules)


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy(REASON).agg(F.count(F.lit(1)).alias("row_count"))
