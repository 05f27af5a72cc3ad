"""Tables that readers always find whole: versions behind a view.

A catalog name is a view of one version, a table of its own over files that never change.
Publishing makes the next version complete, and then replaces the view, which is one change of
metadata: a reader gets the version before it or the one after it, and never none. The version
before stays, files and all, for the readers that planned on it; older ones go.

A version may take directories over from the one before, where they lie. Each version that does
lists where its directories are, and a directory goes when no version left refers to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from adtally.sources.tables import qualified

#: Versions that stay, the current one included.
KEPT_VERSIONS = 2
#: Properties of a view and of a version.
VERSION, FORMER, FOLDER = "adtally.version", "adtally.former", "adtally.folder"
#: Directories that one statement adds to a table.
ADDED_AT_ONCE = 200
_LISTING = "_directories.json"
_NULL_DIRECTORY = "__HIVE_DEFAULT_PARTITION__"


# --- Files ----------------------------------------------------------------------------


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def files(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as it knows it."""
    hadoop = hadoop_path(spark, path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = files(spark, path)
    return fs.exists(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = files(spark, path)
    fs.delete(hadoop, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename; file systems say no by a result that is easily overlooked."""
    fs, hadoop = files(spark, source)
    if not fs.rename(hadoop, hadoop_path(spark, target)):
        raise OSError(f"{source} could not be renamed to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, hadoop = files(spark, path)
    out = fs.create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, hadoop = files(spark, path)
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Names, relative to ``path``, that match a pattern of names; none if there is no folder."""
    fs, hadoop = files(spark, path)
    if not fs.exists(hadoop):
        return []
    depth = pattern.count("/") + 1
    found = fs.globStatus(hadoop_path(spark, f"{path}/{pattern}")) or []
    return ["/".join(s.getPath().toString().split("/")[-depth:]) for s in found]


# --- Versions -------------------------------------------------------------------------


def parts_of(name: str) -> tuple[str, str, str]:
    """Catalog, schema and table of a quoted three-level name."""
    catalog, schema, table = re.findall(r"`([^`]+)`", name) or name.split(".")
    return catalog, schema, table


def versions_folder(spark: SparkSession, name: str) -> str:
    """The folder of a table's versions, beside where a managed table would be."""
    catalog, schema, table = parts_of(name)
    place = spark.catalog.getDatabase(f"`{catalog}`.`{schema}`").locationUri
    return f"{place.rstrip('/')}/{table}-versions"


def _property(spark: SparkSession, name: str, key: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").where(f"key = '{key}'").collect()
    return found[0].value if found else None


def current_version(spark: SparkSession, name: str) -> str | None:
    """The table that ``name`` stands for; None if it is no view of a version."""
    return _property(spark, name, VERSION)


def chain(spark: SparkSession, name: str) -> list[str]:
    """The versions that are there, the current one first."""
    found, version = [], current_version(spark, name)
    while version and spark.catalog.tableExists(version):
        found.append(version)
        version = _property(spark, version, FORMER)
    return found


def directories(
    spark: SparkSession, version: str, partition_by: Sequence[str]
) -> dict[str, str]:
    """Where each directory of a version lies, by its name (``market=DE/date=2026-01-01``)."""
    folder = _property(spark, version, FOLDER)
    if folder is None:
        return {}
    listed = read_text(spark, f"{folder}/{_LISTING}")
    if listed is not None:
        return json.loads(listed)
    if not partition_by:
        return {"": folder}
    pattern = "/".join(f"{c}=*" for c in partition_by)
    return {name: f"{folder}/{name}" for name in names_in(spark, folder, pattern)}


def _literal(value: str) -> str:
    if value == _NULL_DIRECTORY:
        return "NULL"
    escaped = unquote(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _spec(directory: str) -> str:
    pairs = (part.split("=", 1) for part in directory.split("/"))
    return ", ".join(f"`{column}` = {_literal(value)}" for column, value in pairs)


def publish_version(
    spark: SparkSession,
    name: str,
    folder: str,
    schema: StructType,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    taken_over: dict[str, str] | None = None,
    keep: int = KEPT_VERSIONS,
) -> None:
    """Let ``name`` stand for the files in ``folder`` and for the directories taken over.

    All is complete before the view changes; a failure until then leaves the former version in
    place. A plain table of that name, as older releases left it, is dropped before the view
    is made, once.
    """
    catalog, db, table = parts_of(name)
    fresh = qualified(catalog, db, f"{table}__{uuid4().hex[:12]}")
    former = current_version(spark, name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parted = ", ".join(f"`{c}`" for c in partition_by)
    properties = {FOLDER: folder} | ({FORMER: former} if former else {})
    stated = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(
        f"CREATE TABLE {fresh} ({columns}) USING {fmt} "
        + (f"PARTITIONED BY ({parted}) " if partition_by else "")
        + f"LOCATION '{folder}' TBLPROPERTIES ({stated})"
    )
    try:
        if partition_by:
            spark.sql(f"MSCK REPAIR TABLE {fresh}")
        if taken_over:
            own = {
                n: f"{folder}/{n}"
                for n in names_in(spark, folder, "/".join(f"{c}=*" for c in partition_by))
            }
            write_text(spark, f"{folder}/{_LISTING}", json.dumps(taken_over | own))
            _add(spark, fresh, {n: at for n, at in taken_over.items() if n not in own})
        if former is None and spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {name}")
        spark.sql(
            f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{VERSION}' = '{fresh}') "
            f"AS SELECT * FROM {fresh}"
        )
    except Exception:
        if current_version(spark, name) != fresh:
            spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    retire(spark, name, partition_by, keep)


def _add(spark: SparkSession, version: str, places: dict[str, str]) -> None:
    each = [f"PARTITION ({_spec(n)}) LOCATION '{at}'" for n, at in sorted(places.items())]
    for low in range(0, len(each), ADDED_AT_ONCE):
        added = " ".join(each[low : low + ADDED_AT_ONCE])
        spark.sql(f"ALTER TABLE {version} ADD IF NOT EXISTS {added}")


def _root(place: str, directory: str) -> str:
    return place.removesuffix(f"/{directory}") if directory else place


def retire(
    spark: SparkSession, name: str, partition_by: Sequence[str], keep: int = KEPT_VERSIONS
) -> None:
    """Drop the versions beyond the newest ``keep``, and the directories only they refer to."""
    versions = chain(spark, name)
    if len(versions) <= keep:
        return
    stay = [directories(spark, v, partition_by) for v in versions[:keep]]
    used = {place for found in stay for place in found.values()}
    folders = {_root(place, n) for found in stay for n, place in found.items()}
    folders |= {_property(spark, v, FOLDER) for v in versions[:keep]}
    for version in reversed(versions[keep:]):  # the oldest first, so that the chain stays whole
        gone = directories(spark, version, partition_by)
        own = _property(spark, version, FOLDER)
        for root in {_root(place, n) for n, place in gone.items()} | {own}:
            if root not in folders:
                delete(spark, root)
        for n, place in gone.items():
            if place not in used and _root(place, n) in folders:
                delete(spark, place)
        spark.sql(f"DROP TABLE IF EXISTS {version}")


def vacuum(spark: SparkSession, name: str, partition_by: Sequence[str] = ()) -> list[str]:
    """Delete folders that failed drivers left: those that no version refers to.

    Not while another writer is at work on the table, whose folder would look the same.
    """
    versions = chain(spark, name)
    used = {_property(spark, v, FOLDER) for v in versions}
    for v in versions:
        used |= {_root(at, n) for n, at in directories(spark, v, partition_by).items()}
    base = versions_folder(spark, name)
    ends = {u.rstrip("/").rsplit("/", 1)[-1] for u in used if u}
    stray = [f for f in names_in(spark, base) if f not in ends]
    for f in stray:
        delete(spark, f"{base}/{f}")
    catalog, db, table = parts_of(name)
    known = {parts_of(v)[2] for v in versions}
    for t in spark.catalog.listTables(f"`{catalog}`.`{db}`", f"{table}__*"):
        if t.name not in known:
            spark.sql(f"DROP TABLE IF EXISTS {qualified(catalog, db, t.name)}")
    return stray


def without(places: dict[str, str], touched: Iterable[str]) -> dict[str, str]:
    """The directories that a merge does not touch."""
    gone = set(touched)
    return {n: at for n, at in places.items() if n not in gone}


def values_of(directory: str) -> tuple[str, ...]:
    """The column values that a directory's name stands for."""
    return tuple(unquote(part.split("=", 1)[1]) for part in directory.split("/"))


def folder_of(spark: SparkSession, version: str) -> str | None:
    """The folder that a version's own files were written to."""
    return _property(spark, version, FOLDER)
