"""Writes that report their own size, and intermediate tables that cut lineage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from adtally.session import shared_folder


class Size(NamedTuple):
    rows: int
    bytes: int

    def plus(self, other: Size) -> Size:
        return Size(self.rows + other.rows, self.bytes + other.bytes)


class Sized(NamedTuple):
    """A frame over a table on disk, and what the write of that table observed."""

    table: DataFrame
    size: Size


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a flat row in memory: a word per column, and the text."""
    words = F.lit(8 * len(df.columns))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return reduce(add, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], words)


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], Size]]:
    """``df``, and its size once an action has consumed it; no second pass is made.

    Observe right before a write: the tasks of the last stage report once each, however
    often earlier stages had to be repeated.
    """
    seen = Observation()
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")
    )

    def size() -> Size:
        got = seen.get
        return Size(got.get("rows") or 0, got.get("bytes") or 0)

    return watched, size


def written(df: DataFrame, name: str) -> Sized:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where several later steps need the same result: they read it instead of
    repeating its shuffles, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    watched, size = observed(df)
    watched.write.parquet(path)
    return Sized(spark.read.schema(df.schema).parquet(path), size())
