"""Token ids in files of fixed-width bit packing.

A file holds documents in order. Every id takes the bits that the largest id of the
vocabulary needs, so that any id can be found by arithmetic; blocks of ``BLOCK_IDS`` ids
start at byte boundaries listed in the header, and are unpacked by numpy.

Layout, little-endian: magic, bits, ids per block, documents, ids; per document its id, a
null flag and its first id; per block its first byte in the payload; the payload, in which
each id is written most significant bit first.

Rows: a null text is an empty one, and has the end id alone. A null doc_id comes first, and
stays null. Repeated doc_ids are put in order of their texts. An empty table gives no file
and no row. Only doc_id and text are read; other columns do not matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer, pre_tokenizers

from adtally.llm.common import importable, open_shared, stored, table
from adtally.session import shared_folder

MAGIC = b"IDPACK01"
HEAD = struct.Struct("<8sIIQQ")
BLOCK_IDS = 4096
#: Ids after which a file is closed; a document is never split between files.
FILE_IDS = 4_000_000
#: Pieces of text kept per worker with their ids, twice over.
PIECE_CACHE = 450_000
#: Where a piece may be cut: the signs leave out those of contractions and special tokens.
SEAM = re.compile(rb"""[.,;:!?#$%&*()"/=+_~-](?<=[A-Za-z0-9].)""")
MANIFEST = "part INT, seq INT, path STRING, n_docs BIGINT, n_ids BIGINT"


def bits_for(vocab_size: int) -> int:
    """The fewest bits that tell all ids apart."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=">u4")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out = []
    for low in range(0, len(ids), 64 * BLOCK_IDS):
        rows = np.unpackbits(ids[low : low + 64 * BLOCK_IDS].view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(rows[:, 32 - bits :].ravel()).tobytes())
    return b"".join(out)


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, 32 - bits :] = raw
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.uint32)


def encode_file(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """The bytes of one file; ``ids`` are those of all documents, one after another."""
    starts = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    blocks = -(-len(ids) // BLOCK_IDS)
    offsets = np.minimum(np.arange(blocks + 1) * (BLOCK_IDS * bits // 8), -(-len(ids) * bits // 8))
    return b"".join(
        [
            HEAD.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            starts.tobytes(),
            offsets.astype("<u8").tobytes(),
            pack(ids, bits),
        ]
    )


class PackedFile:
    """Random access to one file: only the header is read ahead of the blocks asked for."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block, docs, self.n_ids = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        ids = np.frombuffer(source.read(8 * docs), "<i8")
        nulls = np.frombuffer(source.read(docs), np.uint8)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, nulls)]
        self.starts = np.frombuffer(source.read(8 * (docs + 1)), "<u8").astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.base = HEAD.size + 8 * docs + docs + 8 * (docs + 1) + 8 * (blocks + 1)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids ``low`` to ``high`` (exclusive), from the blocks that hold them."""
        if high <= low:
            return np.zeros(0, np.uint32)
        first, last = low // self.block, (high - 1) // self.block
        at, end = int(self.offsets[first]), int(self.offsets[last + 1])
        self.source.seek(self.base + at)
        begin = first * self.block
        count = min(self.n_ids, (last + 1) * self.block) - begin
        return unpack(self.source.read(end - at), self.bits, count)[low - begin : high - begin]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class PieceEncoder:
    """The tokenizer's ids of whole texts, put together from those of their pieces.

    Only for tokenizers that lower-case, drop white space, and never join letters or digits
    with signs. The ids of a text are then those of its pieces between ASCII white space,
    also where that is put between a letter and a sign; and ASCII letters may be lower-cased
    before, unless combining marks could join them or a special token be made. Pieces recur,
    so most come from a table of bounded size. New ones of Latin letters go straight to the
    tokenizer's model, which they would reach unchanged; all others go to the tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        # How the tokenizer spells the bytes of Latin letters for its model.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = {c: spell(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # those met before the known ones

    def _learn(self, pieces: set[bytes]) -> None:
        for piece in pieces.intersection(self.old):
            self.known[piece] = self.old.pop(piece)
        other = {}
        for piece in pieces.difference(self.known):
            text = piece.decode()
            if text.isalpha() and _latin(text):
                found = self.model.tokenize(text.lower().translate(self.signs))
                self.known[piece] = np.array([t.id for t in found], "<u4").tobytes()
            else:
                other[piece] = text
        made = self.tokenizer.encode_batch(list(other.values()), add_special_tokens=False)
        for piece, found in zip(other, made):
            self.known[piece] = np.array(found.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.known) > PIECE_CACHE:
            self.known, self.old = {}, self.known
        out, late = [], {}
        for k, text in enumerate(texts):
            cut = _pieces(text)
            ids = list(map(self.known.get, cut))
            if None in ids:
                late[k] = [(i, piece) for i, piece in enumerate(cut) if ids[i] is None]
            out.append(ids)
        if late:
            self._learn({piece for gaps in late.values() for _, piece in gaps})
        for k, gaps in late.items():
            for i, piece in gaps:
                out[k][i] = self.known[piece]
        return [b"".join(ids) for ids in out]


def _pieces(text: str) -> list[bytes]:
    data = text.encode()
    if b"<|" not in data and (text.isascii() or _latin(text)):
        data = data.lower()
    return SEAM.sub(rb" \g<0>", data).split()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class Packed(NamedTuple):
    manifest: DataFrame
    folder: str


def write_packed(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, partitions: int | None = None
) -> Packed:
    """Encode ``docs`` and write their ids to ``folder`` in ascending order of doc_id.

    One range shuffle of the texts; each task streams its range into files of bounded size.
    A task that is repeated writes files of other names, and the manifest lists those of
    the attempt that counted, so lost executors and speculation leave nothing wrong.
    """
    spark = docs.sparkSession
    importable(spark)
    bits = bits_for(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True))
    end = np.array([end_id], "<u4").tobytes()
    n = partitions or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, tag = encoder(tokenizer_path), TaskContext.get().partitionId(), uuid4().hex
        seq, doc_ids, lengths, data, held = 0, [], [], [], 0
        listed = []

        def close() -> None:
            nonlocal seq, doc_ids, lengths, data, held
            if doc_ids:
                path = f"{folder}/part-{part:06d}-{seq:05d}-{tag}.ids"
                ids = np.frombuffer(b"".join(data), "<u4")
                with open_shared(path, "wb") as f:
                    f.write(encode_file(doc_ids, lengths, ids, bits))
                listed.append((part, seq, path, len(doc_ids), len(ids)))
                seq, doc_ids, lengths, data, held = seq + 1, [], [], [], 0

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                keys = piece.column(0).to_pylist()
                for key, ids in zip(keys, encode(piece.column(1).to_pylist())):
                    doc_ids.append(key)
                    data.append(ids + end)
                    lengths.append(len(data[-1]) // 4)
                    held += lengths[-1]
                    if held >= FILE_IDS:
                        close()
        close()
        if listed:
            cols = list(zip(*listed))
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["part", "seq", "path", "n_docs", "n_ids"],
            )

    return Packed(stored(rows.mapInArrow(write, MANIFEST), "manifest"), folder)


def read_packed(packed: Packed) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, from the files.

    The only step that sees more than its own file is the sum of ids before each file: a
    row per file, of some millions of ids.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = packed.manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    importable(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                with open_shared(path, "rb") as source:
                    held = PackedFile(source)
                    ids = held.ids(0, held.n_ids).astype("<u4")
                data, starts = memoryview(ids.tobytes()), held.starts
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.doc_ids, pa.int64()),
                        pa.array(starts[:-1] + base, pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        files.select("path", "base")
        .repartition(n)
        .mapInArrow(read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
    )


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as packed ids: its place, length and checksum, read from the files."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_packed(write_packed(docs, f"{shared_folder(spark)}/ids", path, end_id=2))
