"""Writes of tables: balanced layout, replacement in one step, counted rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from adtally.operators.conform import require_schema
from adtally.sources import versions
from adtally.sources.sized import Size, observed
from adtally.sources.tables import require_values

#: Formats that are plain files. Any other one is taken to replace its tables atomically.
FILE_FORMATS = ("parquet", "orc", "avro", "json", "csv")


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle by ``columns`` into tasks of similar size.

    Rows of one output directory meet in few tasks, so it gets few files. Unlike a plain
    hash repartition, a value that holds a large share of the rows (five markets may be
    all there is) is spread over many tasks, and small ones are merged.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def clustered(df: DataFrame, partition_by: Sequence[str], cluster_by: Sequence[str]) -> DataFrame:
    """Shuffle into ranges of directory and ``cluster_by``, and sort each range by them.

    A file then holds a narrow range of the clustering columns, and so does each row group in
    it: a filter on them skips most of a directory by the statistics that Parquet keeps. The
    other columns' hash comes last in the ranges, so that a value which holds a large share of
    a directory is still spread over tasks. The range limits come from a sample, for which the
    input is run through once more.
    """
    order = [*partition_by, *cluster_by]
    others = [c for c in df.columns if c not in order]
    spread = [F.xxhash64(*others)] if others else []
    return df.repartitionByRange(*[F.col(c) for c in order], *spread).sortWithinPartitions(*order)


def _directory_named(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """An empty text as a directory's name would read back as null: writing one fails."""
    texts = [c for c in partition_by if isinstance(df.schema[c].dataType, StringType)]
    return df.withColumns(
        {
            c: F.when(
                F.col(c) == "", F.raise_error(F.lit(f"empty directory value in {c}")).cast("string")
            ).otherwise(F.col(c))
            for c in texts
        }
    )


def declared(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` under its declared schema: other names or types are an error now, a null in a
    required column is one when the row is read."""
    return require_values(require_schema(df, schema, nulls=False), schema)


# --- Tables ---------------------------------------------------------------------------


def _written_to(rows: DataFrame, folder: str, partition_by: Sequence[str], fmt: str) -> None:
    try:
        rows.write.format(fmt).partitionBy(*partition_by).save(folder)
    except Exception:
        versions.delete(rows.sparkSession, folder)
        raise


def overwrite_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    contract: StructType | None = None,
    fmt: str = "parquet",
    laid_out: bool = False,
    cluster_by: Sequence[str] = (),
) -> Size:
    """Replace a catalog table and return the size of what was written.

    Files go to a folder of their own, and ``name``, a view, changes to them in one step when
    they are complete; the former version stays for its readers. A write that fails leaves the
    table as it was. With a ``contract`` the schema must match exactly, or nothing is written.
    Rows that are ``laid_out`` already, because they come unshuffled from a table with the same
    directories, are not shuffled again. With ``cluster_by`` rows are ordered by those columns
    inside the directories, for readers that filter by them.
    """
    if contract is not None:
        require_schema(df, contract)
    spark = df.sparkSession
    rows = _directory_named(df, partition_by)
    if cluster_by:
        rows = clustered(rows, partition_by, cluster_by)
    elif not laid_out:
        rows = balanced(rows, *partition_by)
    watched, size = observed(rows)
    if fmt not in FILE_FORMATS:
        watched.write.format(fmt).partitionBy(*partition_by).mode("overwrite").saveAsTable(name)
        return size()
    folder = f"{versions.versions_folder(spark, name)}/{uuid4().hex}"
    _written_to(watched, folder, partition_by, fmt)
    versions.publish_version(spark, name, folder, watched.schema, partition_by, fmt)
    return size()


def replace_directories(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str],
    touched: Iterable[str],
    contract: StructType | None = None,
    fmt: str = "parquet",
) -> Size:
    """A next version of ``name`` that has ``df`` in place of the directories ``touched``.

    All other directories are taken over where they lie: their files are neither read nor
    written, and keep their names. ``df`` must have rows of the touched directories alone; one
    that gets no rows is gone. Returns the size of what was written.
    """
    if contract is not None:
        require_schema(df, contract)
    spark = df.sparkSession
    version = versions.current_version(spark, name)
    if version is None:
        raise ValueError(f"{name} has no versions to take directories from")
    stay = versions.without(versions.directories(spark, version, partition_by), touched)
    watched, size = observed(balanced(_directory_named(df, partition_by), *partition_by))
    folder = f"{versions.versions_folder(spark, name)}/{uuid4().hex}"
    _written_to(watched, folder, partition_by, fmt)
    versions.publish_version(
        spark, name, folder, watched.schema, partition_by, fmt, taken_over=stay or None
    )
    return size()
