"""Helpers that the operators share: given tables, intermediate tables, words, files."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from adtally.session import shared_folder

#: Words kept per worker with their hash; the table is emptied when it is full.
WORD_CACHE = 400_000
#: Rows of texts that a Python worker gets at once; the JVM and the worker hold several copies
#: of them for each task.
BATCH_ROWS = 1_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_word_hashes: dict[bytes, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark and nothing else, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def small_batches(spark: SparkSession) -> None:
    """Let the session hand rows to Python workers ``BATCH_ROWS`` at a time, or fewer if it does.

    Spark reads the setting when a frame runs, so it stays set; the rows are the same.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:  # below 1: no limit
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, and read from there.

    Several steps read the result; a lost executor then costs a re-read, and the lineage
    ends at the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_name(frame_columns, stem: str) -> str:
    """A column name that no column of the frame has, whatever its case."""
    taken = {c.lower() for c in frame_columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid4().hex[:6]}"
    return name


def by_row(
    df: DataFrame, fn: Callable[..., tuple], columns: list[str], schema: str
) -> DataFrame:
    """``fn`` over the named columns of each row, a batch of Arrow rows at a time.

    ``fn`` gets the values of a row and returns those of the result; the columns of
    ``schema`` are all that comes out.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    importable(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for low in range(0, batch.num_rows, 512):
                rows = [fn(*row) for row in zip(*(x[low : low + 512] for x in lists))]
                if rows:
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(cols, out)], schema=out
                    )

    return df.select(*columns).mapInArrow(run, schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = _word_hashes
    if len(known) > WORD_CACHE:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """Empty the table, where the worker goes on to other work."""
    _word_hashes.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def local_path(uri: str) -> str:
    """The path of a shared folder as a mounted one; other stores need their own client."""
    if "://" in uri and not uri.startswith("file:"):
        raise ValueError(f"{uri} is not mounted")
    return uri.removeprefix("file:").replace("///", "/", 1) if uri.startswith("file:") else uri


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder from a task: a mounted path, or a store of pyarrow."""
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)
    path = local_path(uri)
    if "w" in mode:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, mode)


if sys.byteorder != "little":  # the numpy views below write native order
    raise ImportError("a little-endian machine is needed")
