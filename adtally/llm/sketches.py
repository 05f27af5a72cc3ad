"""Document fingerprints: the shingle hashes below a fixed share of the hash range.

A fingerprint holds every hash of a text's shingles (runs of ``SHINGLE`` code points) that
is below ``1 / SCALE`` of the range, so it grows with the text, and fingerprints of parts
merge into that of the whole. What a short text shares with a long one stays comparable:
likeness is the share of the smaller fingerprint that the other one holds too. A text of
which no hash is below the limit keeps its smallest one, so that only the empty text has an
empty fingerprint; merging follows the same rule.

Rows: a null text is an empty one. A text shorter than a shingle is one shingle. Equal
texts have equal fingerprints, also for repeated rows, which all stay. Two empty
fingerprints have likeness 1, an empty and another one 0. Only doc_id and text are read. In
the order of the edited texts null doc_ids come first, and ties are ordered by text; the
only row of a table is its own follower. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.common import by_row, importable, mixed, table
from adtally.llm.ordered import in_ranges

SHINGLE = 8
SCALE = 16
#: Odd multipliers of the code points in a shingle, from a fixed rule.
WEIGHTS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(text: str) -> np.ndarray:
    """The kept hashes, ascending, as 32-bit numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - SHINGLE + 1
    if not len(points):
        return np.zeros(0, np.uint32)
    if n < 1:
        hashes = mixed((points * WEIGHTS[: len(points)]).sum(keepdims=True) + np.uint64(1))
    else:
        hashes = points[:n] * WEIGHTS[0]
        for k in range(1, SHINGLE):
            hashes += points[k : k + n] * WEIGHTS[k]
        hashes = mixed(hashes)
    return trimmed((hashes >> np.uint64(32)).astype(np.uint32))


def trimmed(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes below the limit, or the smallest if there is none."""
    low = hashes[hashes < 2**32 // SCALE]
    return np.unique(low) if len(low) or not len(hashes) else hashes.min(keepdims=True)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of two texts' shingles taken together."""
    return trimmed(np.concatenate([a, b]))


def to_text(kept: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash."""
    return kept.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ``a``'s shingles that ``b`` has too, as estimated."""
    if not len(a):
        return 1.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller fingerprint that the other one holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return containment(*sorted((a, b), key=len))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of every text, in one pass without a shuffle."""

    def one(doc_id, text):
        return doc_id, to_text(sketch(text or ""))

    return by_row(docs, one, ["doc_id", "text"], "doc_id BIGINT, fingerprint STRING")


COMPARED = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, "
    "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near both are.

    The edited text ends in the beginning of the next document. One shuffle by ranges of
    doc_id; a task needs two neighbouring texts at a time.
    """
    importable(docs.sparkSession)
    rows = in_ranges(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, its range and its sketch
        names = [c.split()[0] for c in COMPARED.split(", ")]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(low, 256).to_pydict()
                for key, text, place, ghost in zip(
                    part["doc_id"], part["text"], part["range_no"], part["ghost"]
                ):
                    mine = sketch(text)
                    if held and held[2] == place:
                        doc_id, own, _, kept = held
                        half = len(own) // 2
                        edited = own[: len(own) - half] + text[:half]
                        changed = sketch(edited)
                        out.append(
                            (
                                doc_id,
                                len(own),
                                hashlib.sha256(edited.encode()).hexdigest(),
                                to_text(kept),
                                to_text(changed),
                                likeness(kept, changed),
                                likeness(kept, mine),
                            )
                        )
                    held = None if ghost else (key, text, place, mine)
                if out:
                    ints, text_, real = pa.int64(), pa.string(), pa.float64()
                    types = [ints, ints, text_, text_, text_, real, real]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names
                    )

    return rows.select("doc_id", "text", "range_no", "ghost").mapInArrow(compare, COMPARED)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its likeness to its edited text and its follower."""
    return compare_edited(table(spark, sf_dir, "documents"))
