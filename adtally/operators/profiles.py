"""Data tests on large tables that read only what changed since the last report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.operators.checks import Check, profile
from adtally.sources import versions
from adtally.sources.sinks import overwrite_table, replace_directories

#: In a profile's folder: where the directories lay that it was made of.
_MADE_OF = "_made_of.json"


def _within(df: DataFrame, partition_by: Sequence[str], names: Sequence[str]) -> Column:
    """A filter on directories alone, which prunes the scan."""

    def same(column: str, value: str) -> Column:
        return F.col(column) == F.lit(value).cast(df.schema[column].dataType)

    each = [
        reduce(and_, [same(c, v) for c, v in zip(partition_by, versions.values_of(n))])
        for n in names
    ]
    return reduce(or_, each, F.lit(False))


def stored_profile(
    spark: SparkSession,
    name: str,
    profile_name: str,
    partition_by: Sequence[str],
    checks: Sequence[Check],
    parents: Sequence[str] = (),
) -> DataFrame:
    """The profile of table ``name``, kept as a table of its own with the same directories.

    A profile counts rows per combination of the columns under test, and nulls, per directory;
    counts add up, so the profiles of all directories are one of the table. Files of a table's
    directory never change, so a directory that lies where it lay needs no new profile, and its
    data is not read. Profiles of directories that changed are made anew and those of
    directories that are gone are dropped, in one step.
    """
    version = versions.current_version(spark, name)
    if version is None:
        raise ValueError(f"{name} has no versions to compare")
    now = versions.directories(spark, version, partition_by)
    table = spark.table(name)
    made_of = _made_of(spark, profile_name)
    if made_of is None:
        rows = profile(table, checks, parents, partition_by)
        overwrite_table(rows, profile_name, partition_by)
    else:
        changed = [n for n, place in now.items() if made_of.get(n) != place]
        gone = [n for n in made_of if n not in now]
        if not changed and not gone:
            return spark.table(profile_name)
        rows = table.where(_within(table, partition_by, changed))
        replace_directories(
            profile(rows, checks, parents, partition_by),
            profile_name,
            partition_by,
            [*changed, *gone],
        )
    folder = versions.folder_of(spark, versions.current_version(spark, profile_name))
    versions.write_text(spark, f"{folder}/{_MADE_OF}", json.dumps(now))
    return spark.table(profile_name)


def _made_of(spark: SparkSession, profile_name: str) -> dict[str, str] | None:
    version = versions.current_version(spark, profile_name)
    if version is None:
        return None
    text = versions.read_text(spark, f"{versions.folder_of(spark, version)}/{_MADE_OF}")
    return None if text is None else json.loads(text)
