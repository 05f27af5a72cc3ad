"""Passages that repeat across documents, by a sparse suffix array over words.

Of the suffixes of a text (in words), those are kept that begin at a minimiser: the k-gram
of ``GRAM`` words with the smallest hash among ``WINDOW`` neighbouring ones. Equal passages
of ``LEAST`` = GRAM + WINDOW - 1 words or more keep suffixes at the same places. Suffixes
whose first k-gram occurs in one text only are dropped; the others are sorted by what follows
the k-gram and compared with their neighbours, extended to the left and to the right. A
second order, by what stands to the left, finds neighbours that are alike there.

A suffix carries the ``WINDOW - 1`` words on both sides of its k-gram: as far as that, the
first and the last kept suffix of a passage reach its ends, and those in between reach each
other, so the union of what all suffixes mark is the passage, however long it is.

In a k-gram that many texts hold, nearer neighbours may hide a partner. So the windows of
``LEAST`` words whose minimiser is a shared k-gram also meet by 128 bits made of the hashes
of the k-grams that cover them: texts that share ``LEAST`` words share a window, whatever
else stands around it. For other words to pass, they must agree with all but one of these
k-grams and collide in its 64 bits.

Sorting is a range shuffle, which also splits a k-gram that very many texts hold. What meets
at the borders of tasks is compared afterwards, task by task: the first and the last text of
each with the nearest row of another text in the tasks before and after it, which are found
from four rows a task. So a k-gram of very many rows is no task of its own there either.

Rows: words are bytes between ASCII white space, A-Z lower-cased. Texts that are equal as
wholes are taken as one and as passages of each other, if they have ``LEAST`` words. Null,
empty and shorter texts have no passages. Repeated rows are one document, and partners have
another doc_id; a null doc_id has passages of its own but is no partner. An empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.common import importable, mixed, stored, table, word_hashes

GRAM, WINDOW = 20, 31
LEAST = GRAM + WINDOW - 1
SIDE = WINDOW - 1
WEIGHTS = mixed(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)
#: Texts up to which their numbers are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 1_000_000


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's minimiser, ascending, and the hashes of all k-grams."""
    n = len(words) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = words[:n] * WEIGHTS[0]
    for k in range(1, GRAM):
        grams += words[k : k + n] * WEIGHTS[k]
    grams = mixed(grams)
    return np.arange(n - WINDOW + 1) + sliding_window_view(grams, WINDOW).argmin(axis=1), grams


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes, ascending, and the hashes of their k-grams."""
    at, grams = minimisers(words)
    at = np.unique(at)
    return at, grams[at]


ANCHOR = "node BIGINT, place INT, gram BIGINT"


def kept_suffixes(texts: DataFrame) -> DataFrame:
    """``(node, place, gram)`` of all kept suffixes; a null gram tells the number of words."""
    importable(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                nodes, places, grams = [], [], []
                part = batch.slice(low, 256)
                for node, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = word_hashes((text or b"").lower().split())
                    if len(words) >= LEAST:
                        at, own = anchors(words)
                        nodes.append(np.full(len(at) + 1, node, np.int64))
                        places += [np.array([len(words)]), at]
                        grams += [np.zeros(1, np.int64), own.view(np.int64)]
                if nodes:
                    place, gram = np.concatenate(places), np.concatenate(grams)
                    heads = np.cumsum([0] + [len(x) for x in nodes[:-1]])
                    null = np.zeros(len(gram), bool)
                    null[heads] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(nodes)),
                            pa.array(place.astype(np.int32)),
                            pa.array(gram, mask=null),
                        ],
                        names=["node", "place", "gram"],
                    )

    return texts.select("node", "text").mapInArrow(run, ANCHOR)


SUFFIX = "gram BIGINT, right BINARY, left BINARY, node BIGINT, place INT"


def with_sides(texts: DataFrame) -> DataFrame:
    """The suffixes of ``(node, text, suffixes)`` with the words around their k-grams.

    Words are 32-bit hashes, highest byte first, those to the left in reverse.
    """
    importable(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(low, 64)
                for node, text, suffixes in zip(*(c.to_pylist() for c in part.columns)):
                    words = (word_hashes(text.lower().split()) >> np.uint64(32)).astype(">u4")
                    data, back = words.tobytes(), words[::-1].tobytes()
                    n = len(words)
                    for s in suffixes:
                        at = s["place"]
                        end, rest = at + GRAM, n - at
                        out.append(
                            (
                                s["gram"],
                                data[4 * end : 4 * (end + SIDE)],
                                back[4 * rest : 4 * (rest + SIDE)],
                                node,
                                at,
                            )
                        )
                if out:
                    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)],
                        names=["gram", "right", "left", "node", "place"],
                    )

    return texts.select("node", "text", "suffixes").mapInArrow(run, SUFFIX)


WINDOWS = "key BIGINT, check BIGINT, node BIGINT, low INT"


def windows(texts: DataFrame) -> DataFrame:
    """The windows of ``(node, text, suffixes)`` whose minimiser is one of the suffixes."""
    importable(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                keys, checks, nodes, lows = [], [], [], []
                for node, text, suffixes in zip(*(c.to_pylist() for c in part.columns)):
                    at, grams = minimisers(word_hashes(text.lower().split()))
                    own = np.flatnonzero(np.isin(at, [s["place"] for s in suffixes]))
                    key, check = grams[own] * WEIGHTS[0], grams[own] * WEIGHTS[3]
                    for k, ahead in enumerate((GRAM, LEAST - GRAM), 1):  # they overlap
                        key += grams[own + ahead] * WEIGHTS[k]
                        check += grams[own + ahead] * WEIGHTS[3 + k]
                    keys.append(mixed(key).view(np.int64))
                    checks.append(mixed(check).view(np.int64))
                    nodes.append(np.full(len(own), node, np.int64))
                    lows.append(own.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (keys, checks, nodes, lows)],
                    names=["key", "check", "node", "low"],
                )

    return texts.select("node", "text", "suffixes").mapInArrow(run, WINDOWS)


def window_marks(texts: DataFrame) -> DataFrame:
    """Marks of all windows that another text holds too."""
    found = stored(windows(texts), "windows")
    shared = (
        found.groupBy("key", "check")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most")
    )
    other = F.when(F.col("node") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    met = found.join(stored(shared, "shared"), ["key", "check"]).select(
        "node", "low", (F.col("low") + LEAST).alias("high"), other.alias("partner")
    )
    return stored(met, "met")


def common_words(a: bytes, b: bytes) -> int:
    """How many words two sides have in common from their beginnings."""
    if a == b:
        return len(a) // 4
    n = min(len(a), len(b)) // 4
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[: 4 * mid] == b[: 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


SPANS = "node BIGINT, low INT, high INT, partner BIGINT"
SPAN_NAMES = ["node", "low", "high", "partner"]
ROW = "gram BIGINT, right BINARY, left BINARY, node BIGINT, place INT"
MARK = (
    "node BIGINT, low INT, high INT, partner BIGINT, border INT, role INT, gram BIGINT, "
    "right BINARY, left BINARY"
)
#: What a row at the edge of a task is: one of its first or its last text, or the very first
#: row, the first one of the second text, the last row, the last one of the text before.
FIRST_TEXT, LAST_TEXT, FIRST, SECOND, LAST, FORMER = range(6)


def matched(x: tuple, y: tuple) -> list[tuple]:
    """Marks in both texts of what two suffixes of a k-gram have in common around it."""
    left = common_words(x[2], y[2])
    length = left + GRAM + common_words(x[1], y[1])
    if length < LEAST:
        return []
    return [
        (one[3], one[4] - left, one[4] - left + length, other[3]) for one, other in ((x, y), (y, x))
    ]


def columns_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "BINARY": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields)],
        names=[name for name, _ in fields],
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Marks ``(node, low, high, partner)`` of sorted suffixes, compared with their neighbours.

    A row's neighbours are the nearest rows of other texts before and after it with the same
    k-gram. Rows at the edges of each task come out as well, with its number and their role.
    """
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        own: list[tuple] = []  # the run: rows of one text and k-gram, one after another
        last: list[tuple] = []  # the run before it
        runs = 0

        def compare(x: tuple, y: tuple) -> None:
            out.extend((*m, *[None] * 5) for m in matched(x, y))

        def mark_edge(rows_: list[tuple], role: int) -> None:
            out.extend((r[3], r[4], None, None, part, role, r[0], r[1], r[2]) for r in rows_)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own and (own[-1][3] != row[3] or own[-1][0] != row[0]):
                    if own[-1][0] == row[0]:
                        for x in own:
                            compare(x, row)
                    runs += 1
                    if runs == 1:
                        mark_edge(own, FIRST_TEXT)
                        mark_edge(own[:1], FIRST)
                        mark_edge([row], SECOND)
                    last, own = own, []
                elif own and last and last[-1][0] == row[0]:
                    compare(last[-1], row)
                own.append(row)
            if out:
                yield columns_of(out, MARK)
                out.clear()
        if runs == 0:
            mark_edge(own, FIRST_TEXT)
            mark_edge(own[:1], FIRST)
        mark_edge(own, LAST_TEXT)
        mark_edge(own[-1:], LAST)
        mark_edge(last[-1:], FORMER)
        yield columns_of(out, MARK)

    return rows.select("gram", "right", "left", "node", "place").mapInArrow(run, MARK)


def nearest(ends: DataFrame, before: bool) -> DataFrame:
    """``(border, role, seen)``: rows of the tasks before (or after) each one, nearest first.

    They are the nearest row and the nearest one of another text with the same k-gram. The
    only step over all tasks, of four rows for each.
    """
    roles = (LAST, FORMER) if before else (FIRST, SECOND)
    role = FIRST_TEXT if before else LAST_TEXT
    held = ends.where(F.col("role").isin(*roles)).select(
        "border", "role", "gram", "right", "left", "node", F.col("low").alias("place")
    )
    order = F.col("border").asc() if before else F.col("border").desc()
    schema = f"border INT, role INT, {', '.join('seen_' + c for c in ROW.split(', '))}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own, seen = None, [], []

        def past(own: list[tuple], seen: list[tuple]) -> list[tuple]:
            head, *rest = [*own, *seen]
            other = [r for r in rest if r[0] == head[0] and r[3] != head[3]]
            return [head, *other[:1]]

        for batch in batches:
            out = []
            for border, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if border != task:
                    seen = past(own, seen) if own else seen
                    task, own = border, []
                    out += [(border, role, *r) for r in seen]
                own.append(tuple(row))
            yield columns_of(out, schema)

    return held.coalesce(1).sortWithinPartitions(order, "role").mapInArrow(scan, schema)


def across(made: DataFrame) -> DataFrame:
    """Marks between the first and last texts of tasks and the nearest rows beyond."""
    ends = made.where(F.col("role") >= FIRST)
    seen = nearest(ends, before=True).unionAll(nearest(ends, before=False))
    edges = made.where(F.col("role") < FIRST).withColumnRenamed("low", "place")
    names = [c.split()[0] for c in ROW.split(", ")]
    meets = edges.join(stored(seen, "seen"), ["border", "role"]).where(
        "gram = seen_gram AND node <> seen_node"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out += matched(row[:5], row[5:])
            yield columns_of(out, SPANS)

    return meets.select(*names, *("seen_" + c for c in names)).mapInArrow(run, SPANS)


def marks(suffixes: DataFrame) -> DataFrame:
    """Marks from both orders of the suffixes, borders of tasks included."""
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for order in (["gram", "right", "left"], ["gram", "left", "right"]):
        order = [*order, "node", "place"]
        ranged = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
        made = stored(neighbours(ranged), "marks")
        found += [made.where("border IS NULL").select(*SPAN_NAMES), across(made)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole




def joined_marks(marked: DataFrame) -> DataFrame:
    """Marks of a text that overlap, put together; the partner is that of the longest one.

    A text's marks are at most a few for each of its suffixes, and one for each word.
    """
    importable(marked.sparkSession)
    lists = (
        marked.groupBy("node", "low", "high")
        .agg(F.min("partner").alias("partner"))
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high", "partner"))).alias("marks"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, own in zip(*(c.to_pylist() for c in batch.columns)):
                spans: list[list] = []
                for m in own:
                    length = m["high"] - m["low"]
                    if spans and m["low"] < spans[-1][1]:
                        last = spans[-1]
                        last[1] = max(last[1], m["high"])
                        if length > last[3]:
                            last[2:] = [m["partner"], length]
                    else:
                        spans.append([m["low"], m["high"], m["partner"], length])
                out += [(node, low, high, partner) for low, high, partner, _ in spans]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)],
                names=["node", "low", "high", "partner"],
            )

    return lists.select("node", "marks").mapInArrow(run, SPANS)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_word, end_word, n_words, partner_id)``, a row per passage.

    The partner is one of the documents that hold the passage, or the part of it that was
    found as a whole.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("node"), text.cast("binary").alias("text")
    )
    thin = stored(kept_suffixes(rows), "suffixes")
    lengths = thin.where("gram IS NULL").select("node", F.col("place").alias("words")).distinct()
    real = thin.where("gram IS NOT NULL")
    shared = (
        real.groupBy("gram")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("gram")
    )
    places = stored(
        real.join(stored(shared, "grams"), "gram", "left_semi")
        .distinct()
        .groupBy("node")
        .agg(F.collect_list(F.struct("place", "gram")).alias("suffixes")),
        "places",
    )
    wanted = places.select("node")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = (
        rows.select("node", "text")
        .join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("text").alias("text"))
        .join(places, "node")
    )
    texts = stored(texts, "texts")
    sides = stored(with_sides(texts), "sides")
    spans = joined_marks(marks(sides).unionAll(window_marks(texts)))

    owners = stored(rows.select("doc_id", "node").distinct(), "owners")
    ends = owners.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    ends = stored(ends, "ends")
    # A text that several documents hold as a whole is one passage.
    copies = (
        ends.where("least < most OR least IS NULL")
        .join(lengths, "node")
        .where("least < most")
        .select("node", F.lit(0).alias("low"), F.col("words").alias("high"), "least", "most")
    )
    spans = spans.join(copies.select("node"), "node", "left_anti").join(
        ends.select(F.col("node").alias("partner"), F.col("least").alias("partner_id")), "partner"
    )
    own = F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    parts = owners.join(spans, "node").select("doc_id", "low", "high", "partner_id")
    whole = owners.join(copies, "node").select("doc_id", "low", "high", own.alias("partner_id"))
    return parts.unionAll(whole).select(
        "doc_id",
        F.col("low").alias("first_word"),
        F.col("high").alias("end_word"),
        (F.col("high") - F.col("low")).alias("n_words"),
        "partner_id",
    )


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's passages of 50 words or more that another document holds too."""
    return repeated_passages(table(spark, sf_dir, "documents"))
