"""Harmonic packing of token ids into sequences of one length.

A document is cut into pieces, and a piece of ``n`` ids belongs to class ``capacity // n``: as
many pieces of that class as its number fill a sequence. Every worker fills the sequences of
each class by itself, by that fixed count, in the order in which its documents come.

Cuts. Whole sequences are cut from a document first. The rest stays as it is if its class fills
a sequence but for ``SLACK`` ids; else the largest piece of the next class is cut from it, and
the remainder is treated alike. Pieces of class ``SMALL`` and above share one last class, whose
sequences are filled one after another; a piece that crosses the end of one is cut there. No
sequence but the last ones of all is thus padded by more than ``SLACK`` ids.

Leftovers. A worker is left with fewer pieces of a class than fill a sequence. Those of
``FAN_IN`` workers at a time meet, fill sequences by the same rule and leave fewer, until one
group is left; what that group leaves, under ``SMALL`` sequences, is laid out end to end, and its
last ids make sequences of falling powers of two, which need no padding.

Rows: a null text is an empty one, and has the end id alone. A null doc_id stays null. Repeated
rows and doc_ids are documents of their own, and ties are kept in the order of the input. A very
long text becomes many whole sequences. An empty table gives no rows. Only doc_id and text are
read; other columns do not matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from adtally.llm.common import importable, stored, table

CAPACITY = 2_048
#: The first class whose pieces are laid end to end instead of being counted.
SMALL = 16
#: Ids that a sequence may lack.
SLACK = 8
#: Workers whose leftovers meet in one group.
FAN_IN = 64
#: Texts whose ids are laid out at once, and bytes of text whose words are numbered at once.
LAID_OUT, NUMBERED = 512, 12_000_000
#: Ids after which finished sequences are handed on.
FLUSHED = 2_000_000

PIECES = (
    "doc_id BIGINT, start BIGINT, ids BINARY, doc_tokens BIGINT, sequence_id BIGINT, "
    "offset BIGINT, class INT, worker INT"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("class", pa.int32()),
        ("worker", pa.int32()),
    ]
)


# --- Token ids ------------------------------------------------------------------------


class WordEncoder:
    """The tokenizer's ids of whole texts, put together from those of their words.

    For byte-level tokenizers that put a space in front of the letters, digits or signs that
    follow it, and let neither letters nor digits join with a closing sign. A text may then be
    cut before every space that no white space follows, and before a closing sign that stands
    after an ASCII letter or digit. Words recur, so Arrow numbers those of many texts at once,
    each is encoded once, and numpy lays out their ids. New words of Latin letters go straight
    to the model of the tokenizer. Texts with runs of white space are encoded whole.
    """

    #: White space, and text that is not cut into words.
    WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}" + (
        r"\x{202f}\x{205f}\x{3000}]"
    )
    WHOLE = rf" (?:{WHITE}|\z)|\x{{00}}"
    CLOSING = r"([A-Za-z0-9])([.,;:!?])"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.space = spell(" ")[0][0]
        self.signs = {c: spell(chr(c))[0][0] for c in range(0x80, 0x100)}

    def plain(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word; a zero character in front says that no space was there."""
        out, other, model, space = [b""] * len(words), [], self.model.tokenize, self.space
        for k, word in enumerate(words):
            if word.isalpha() and (word.isascii() or max(word) < "Ā"):
                spelled = word if word.isascii() else word.translate(self.signs)
                out[k] = array("I", [t.id for t in model(space + spelled)]).tobytes()
            else:
                other.append(k)
        texts = [words[k][1:] if words[k][:1] == "\0" else " " + words[k] for k in other]
        for k, ids in zip(other, self.plain(texts)):
            out[k] = ids
        return out

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        whole = pc.match_substring_regex(texts, self.WHOLE)
        cut = pc.if_else(whole, "", texts)
        cut = pc.replace_substring_regex(cut, self.CLOSING, "\\1 \0\\2")
        words = pc.split_pattern(pc.binary_join_element_wise("\0", cut, ""), " ")
        numbered = words.flatten().dictionary_encode()
        ids = self._encoded(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        places, ends = numbered.indices.to_numpy(), words.offsets.to_numpy()
        rest = iter(self.plain(texts.filter(whole).to_pylist()))
        marks = whole.to_pylist()
        for low in range(0, len(texts), LAID_OUT):
            high = min(len(texts), low + LAID_OUT)
            own = places[ends[low] - ends[0] : ends[high] - ends[0]]
            lengths = sizes[own]
            before = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(starts[own] - before[:-1], lengths) + np.arange(before[-1])
            data = flat[at].tobytes()
            for k in range(low, high):
                span = before[ends[k] - ends[low]], before[ends[k + 1] - ends[low]]
                yield next(rest) if marks[k] else data[4 * span[0] : 4 * span[1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- Classes and sequences ------------------------------------------------------------


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        number = capacity // rest
        if number >= SMALL or number * rest >= capacity - SLACK:
            out.append(rest)
            break
        out.append(capacity // (number + 1))
        rest -= out[-1]
    return out


class Filler:
    """Fills sequences by class; pieces are lists of ``[doc_id, start, ids, doc_tokens]``."""

    def __init__(self, capacity: int, first_id: int, worker: int):
        self.capacity, self.next_id, self.worker = capacity, first_id, worker
        self.open: dict[int, list] = {}
        self.held = 0  # ids in the open sequence of small pieces
        self.rows: list[tuple] = []
        self.tokens = 0  # in the rows

    def close(self, pieces: list, number: int) -> None:
        offset = 0
        for doc_id, start, ids, whole in pieces:
            row = (doc_id, start, ids, whole, self.next_id, offset, number, self.worker)
            self.rows.append(row)
            offset += len(ids) // 4
        self.tokens += offset
        self.next_id += 1

    def add(self, piece: list) -> None:
        size = len(piece[2]) // 4
        number = self.capacity // size
        if number >= SMALL:
            self.add_small(piece, SMALL)
            return
        pieces = self.open.setdefault(number, [])
        pieces.append(piece)
        if len(pieces) == number:
            self.close(self.open.pop(number), number)

    def add_small(self, piece: list, number: int) -> None:
        """End to end: a piece that crosses the end of a sequence is cut there."""
        doc_id, start, ids, whole = piece
        while ids:
            room = self.capacity - self.held
            part, ids = ids[: 4 * room], ids[4 * room :]
            self.open.setdefault(number, []).append([doc_id, start, part, whole])
            start += len(part) // 4
            self.held += len(part) // 4
            if self.held == self.capacity:
                self.close(self.open.pop(number), number)
                self.held = 0

    def leftovers(self) -> list[tuple]:
        return [
            (*piece, None, None, number, self.worker)
            for number, pieces in sorted(self.open.items())
            for piece in pieces
        ]

    def finish(self) -> None:
        """Lay out what is left end to end, the last ids in powers of two."""
        rest = [piece for _, pieces in sorted(self.open.items()) for piece in pieces]
        self.open, self.held = {}, 0
        for piece in rest:
            self.add_small(piece, 0)
        last, size = self.open.pop(0, []), self.held
        power = self.capacity
        while power:
            if size & power:
                taken, room = [], power
                while room:
                    doc_id, start, ids, whole = last[0]
                    part = ids[: 4 * room]
                    taken.append([doc_id, start, part, whole])
                    room -= len(part) // 4
                    if len(part) == len(ids):
                        last.pop(0)
                    else:
                        last[0] = [doc_id, start + len(part) // 4, ids[len(part) :], whole]
                self.close(taken, 0)
            power >>= 1

    def flushed(self) -> pa.RecordBatch:
        rows, self.rows, self.tokens = self.rows, [], 0
        return _batch(rows)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of the batch, some ``NUMBERED`` bytes at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + NUMBERED, side="right")))
        yield tuple(c.slice(low, high - low) for c in batch.columns)
        low = high


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW
    )


def _first_id(level: int, worker: int) -> int:
    """Sequences are numbered by level, worker and place, so no two share a number."""
    return level << 58 | worker << 34


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset, class)`` per piece.

    ``ids`` are the piece's ids as little-endian 32-bit integers; ``class`` is 0 for pieces of
    the last sequences. Texts are read where they lie and never shuffled; only leftovers are,
    of which a worker has less than ``SMALL`` sequences.
    """
    importable(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = encoder(tokenizer_path), TaskContext.get().partitionId()
        filler = Filler(capacity, _first_id(0, worker), worker)
        for batch in batches:
            for keys, texts in _portions(batch):
                for key, ids in zip(keys.to_pylist(), encode(texts)):
                    ids += end
                    whole, start = len(ids) // 4, 0
                    for size in cuts(whole, capacity):
                        part = ids[4 * start : 4 * (start + size)]
                        filler.add([key, start, part, whole])
                        start += size
                    if filler.tokens > FLUSHED:
                        yield filler.flushed()
        yield filler.flushed()
        yield _batch(filler.leftovers())

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    levels = [stored(rows.mapInArrow(fill, PIECES), "pieces_0")]
    groups = (levels[0].agg(F.max("worker")).first()[0] or 0) + 1
    while True:
        groups, level = -(-groups // fan_in), len(levels)
        levels.append(stored(_met(levels[-1], level, capacity, fan_in, groups == 1), f"p_{level}"))
        if groups == 1:
            break
    placed = reduce(DataFrame.unionAll, levels).where(F.col("sequence_id").isNotNull())
    return placed.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        "ids",
        "doc_tokens",
        "sequence_id",
        "offset",
        "class",
    )


def _met(pieces: DataFrame, level: int, capacity: int, fan_in: int, last: bool) -> DataFrame:
    """The leftovers of ``fan_in`` workers at a time, filled into sequences."""

    def meet(leftovers: pa.Table) -> pa.Table:
        leftovers = leftovers.sort_by([("worker", "ascending")])  # a stable sort
        worker = leftovers.column("worker")[0].as_py() // fan_in
        filler = Filler(capacity, _first_id(level, worker), worker)
        columns = ("doc_id", "start", "ids", "doc_tokens", "class")
        for *piece, number in zip(*(leftovers.column(c).to_pylist() for c in columns)):
            if number == SMALL:
                filler.add_small(piece, SMALL)
            else:
                filler.add(piece)
        if last:
            filler.finish()
        return pa.Table.from_batches([_batch(filler.rows + filler.leftovers())])

    left = pieces.where(F.col("sequence_id").isNull())
    group = F.floor(F.col("worker") / fan_in)
    return left.groupBy(group).applyInArrow(meet, PIECES)


def sequences(pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, n_tokens, ids, doc_ids, lengths)``: each sequence put together.

    A sequence whose length is a power of two stays so; all others are padded to ``capacity``.
    No group has more than ``capacity`` ids.
    """
    part = F.struct("offset", "length", "doc_id", "ids")
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    n = F.col("n_tokens")
    pad = F.to_binary(F.lit(array("I", [pad_id]).tobytes().hex()), F.lit("hex"))
    room = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(capacity))
    joined = F.aggregate("parts", F.to_binary(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    return whole.select(
        "sequence_id",
        "n_tokens",
        F.rpad(joined, (4 * room).cast("int"), pad).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    )


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids: each piece, its checksum and its place."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), path, end_id=1).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
