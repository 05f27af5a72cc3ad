"""The quarantine: rejected rows by run, under a schema that may widen."""

from __future__ import annotations

import json
import re
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

from adtally.operators.conform import SchemaMismatch
from adtally.sources import versions
from adtally.sources.contracts import BATCH_TIME, QUARANTINED_AT
from adtally.sources.sinks import balanced
from adtally.sources.sized import Size, observed

# A leading letter keeps a run id from being read back as a number or a date.
_RUN_ID = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
#: In a run's directory, where readers of data do not look: the time of its batch.
_BATCH = "_batch.json"
#: The schemas that the quarantine has had, by number; the last one is in force.
_LEDGER = "_schemas"

_WHOLE = (ByteType, ShortType, IntegerType, LongType)


class OtherBatch(ValueError):
    """A run id that is in use was given for a batch of another time."""


# --- The ledger of schemas ------------------------------------------------------------


def widens(old: DataType, new: DataType) -> bool:
    """Whether every value of ``old`` is one of ``new``, which readers can then take for it."""
    if isinstance(old, _WHOLE):
        if isinstance(new, _WHOLE):
            return _WHOLE.index(type(new)) > _WHOLE.index(type(old))
        return isinstance(new, DoubleType) and not isinstance(old, LongType)
    if isinstance(old, FloatType):
        return isinstance(new, DoubleType)
    if isinstance(old, DecimalType) and isinstance(new, DecimalType):
        more_digits = new.precision - new.scale >= old.precision - old.scale
        return new != old and new.scale >= old.scale and more_digits
    return False


def merged_schema(stored: StructType, batch: StructType) -> StructType:
    """The stored columns, widened where the batch has a wider type, then its new columns.

    Any other change of a type is refused, a narrower one too: the quarantine would have to
    change the batch's rows or its own.
    """
    have = {f.name: f.dataType for f in stored.fields}
    types = {f.name: f.dataType for f in batch.fields}
    changed = {n: t for n, t in types.items() if n in have and have[n] != t}
    refused = [
        (n, t.simpleString(), have[n].simpleString())
        for n, t in changed.items()
        if not widens(have[n], t)
    ]
    if refused:
        raise SchemaMismatch(f"types other than those in the quarantine: {refused}")
    fields = [StructField(n, changed.get(n, t)) for n, t in have.items()]
    fields += [StructField(n, t) for n, t in types.items() if n not in have]
    return StructType(fields)


def ledger(spark: SparkSession, path: str) -> list[StructType]:
    """The schemas that the quarantine has had, the one in force last."""
    names = sorted(versions.names_in(spark, f"{path}/{_LEDGER}", "[0-9]*.json"))
    texts = [versions.read_text(spark, f"{path}/{_LEDGER}/{n}") for n in names]
    return [StructType.fromJson(json.loads(t)) for t in texts]


def _enter(spark: SparkSession, path: str, schema: StructType, number: int) -> None:
    """A new entry, complete before it has its name; a second writer of it fails."""
    draft = f"{path}/{_LEDGER}/draft-{uuid4().hex}"
    versions.write_text(spark, draft, schema.json())
    versions.rename(spark, draft, f"{path}/{_LEDGER}/{number:06d}.json")


# --- Runs -----------------------------------------------------------------------------


def _time_of(df: DataFrame) -> int | None:
    """The batch's time as ``rejected`` states it with its column, rows or no rows."""
    if QUARANTINED_AT not in df.columns:
        return None
    return df.schema[QUARANTINED_AT].metadata.get(BATCH_TIME)


def _stored_time(spark: SparkSession, target: str, schema: StructType, fmt: str) -> int | None:
    noted = versions.read_text(spark, f"{target}/{_BATCH}")
    if noted is not None:
        return json.loads(noted)["time"]
    if QUARANTINED_AT not in schema.names:
        return None
    latest = F.max(F.unix_micros(QUARANTINED_AT))
    return spark.read.schema(schema).format(fmt).load(target).agg(latest).first()[0]


def _recover(spark: SparkSession, path: str) -> None:
    """Finish what a driver that died between two renames left: a run set aside comes back,
    unless its replacement is there."""
    for aside in versions.names_in(spark, path, "_aside-*"):
        run = aside.split(".", 1)[1]
        if versions.exists(spark, f"{path}/{run}"):
            versions.delete(spark, f"{path}/{aside}")
        else:
            versions.rename(spark, f"{path}/{aside}", f"{path}/{run}")


def _swap(spark: SparkSession, path: str, staged: str, run: str) -> None:
    """Put a run's new directory in place of its old one, or leave the old one there."""
    target, aside = f"{path}/{run}", f"{path}/_aside-{uuid4().hex}.{run}"
    replacing = versions.exists(spark, target)
    try:
        if replacing:
            versions.rename(spark, target, aside)
        versions.rename(spark, staged, target)
    except Exception:
        if replacing and not versions.exists(spark, target):
            versions.rename(spark, aside, target)
        versions.delete(spark, staged)
        raise
    if replacing:
        versions.delete(spark, aside)


def write_rejected(
    df: DataFrame, path: str, run_id: str, fmt: str = "parquet", table: str | None = None
) -> Size:
    """Add one run's rejects to the quarantine at ``path``; return what was written.

    Each run owns a directory and replaces only that one, so the quarantine grows by run
    and a repeated run does not add its rows twice. A run id that holds a batch of another
    time is refused, also if the new batch is empty, and so is an empty batch that does not say
    its time. New columns are welcome and so are wider types, under which older runs are then
    read; any other type is refused. If the new directory cannot take the old one's place, the
    old one stays. With ``table`` the quarantine is also a catalog table, with the columns of
    all runs.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r} must be a letter, then letters, digits, _ or -")
    spark, path = df.sparkSession, path.rstrip("/")
    _recover(spark, path)
    known = ledger(spark, path)
    runs = versions.names_in(spark, path, "run_id=*")
    if known:
        stored = known[-1]
    else:  # a quarantine from before the ledger, or none
        stored = read_rejected(spark, path, fmt).drop("run_id").schema if runs else StructType()
    schema = merged_schema(stored, df.schema)
    run, staged = f"run_id={run_id}", f"{path}/_staged-{uuid4().hex}"
    held = None
    if run in runs:
        held = _stored_time(spark, f"{path}/{run}", schema, fmt)
    now, seen, counted = _time_of(df), Observation(), balanced(df)
    if held is not None and now is not None and held != now:
        raise OtherBatch(f"run {run_id} holds rejects of another time ({held}, not {now})")
    dated = now is None and QUARANTINED_AT in df.columns
    if dated:
        counted = counted.observe(seen, F.max(F.unix_micros(QUARANTINED_AT)).alias("latest"))
    watched, size = observed(counted)
    try:
        watched.write.format(fmt).save(staged)
        if dated:
            now = seen.get["latest"]
        if held is not None and now != held:
            raise OtherBatch(f"run {run_id} holds rejects of another time ({held}, not {now})")
        versions.write_text(spark, f"{staged}/{_BATCH}", json.dumps({"time": now}))
        if not known or known[-1] != schema:
            _enter(spark, path, schema, len(known))
    except Exception:
        versions.delete(spark, staged)
        raise
    _swap(spark, path, staged, run)
    if table:
        whole = StructType([*schema.fields, StructField("run_id", StringType())])
        versions.publish_version(spark, table, path, whole, ["run_id"], fmt)
    return size()


def read_rejected(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All runs, under the schema in force, and ``run_id``: older runs have nulls for newer
    columns, and their values under wider types."""
    known = ledger(spark, path)
    if known:
        whole = StructType([*known[-1].fields, StructField("run_id", StringType())])
        return spark.read.schema(whole).format(fmt).load(path)
    return spark.read.option("mergeSchema", "true").format(fmt).load(path)
