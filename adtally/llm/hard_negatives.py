"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

An anchor's positives are the rows of its label with the highest inner products. For each of
them, its negatives are the rows of other labels whose scores lie in a window set by the
positive's score, the highest first. Both are the first ``k`` rows within bounds of a score,
and found in the same way.

Rows are dealt evenly into shards. A shard's index has a posting list for each run of
dimensions, those of most weight first; a row is listed there only as far as the norm of its
remaining dimensions could lift a score to the threshold, and not at all beyond. Lists are kept
by falling norm, so a threshold picks a beginning of each. Scores are accumulated run by run,
rows go as soon as the remaining norms cannot lift them to the threshold, and the rest is scored
exactly. The threshold starts high and is lowered until a window has its rows, or the window's
lower bound is reached. Shards that one task visits with the same anchors share their kth score.

Anchors are few: they are gathered into full blocks, which go to runs of shards; the shards are
shuffled once, however many anchors there are.

Rows: a vector takes no part if it is null, holds a null or a component that is not finite, or
has no vec_id or no label. Only vectors of equal length meet; empty ones have score 0. Repeated
rows are rows of their own: each is an anchor, a positive, a negative, and only its own row is
not met. Ties go to the smaller vec_id. Scores and scaled components beyond 64 bits are clipped.
An anchor without another row of its label has no rows, and neither has a positive with an empty
window, such as one with a score below 0. An empty table gives no rows. Only vec_id, embedding
and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtally.llm.ball_tree import packed, unpacked
from adtally.llm.common import importable, stored, table

SCALE = 256.0
SHARD_ROWS = 8_192
BLOCK_ROWS = 2_048
#: Shards that one task takes a block of anchors through, handing on its kth scores.
SHARDS_AT_ONCE = 16
#: Dimensions of a posting list.
STEP = 16
#: Thresholds, as shares of the way from a window's floor to its upper bound.
SHARES = tuple(s / 16 for s in (15, 14, 13, 12, 11, 10, 9, 8, 4, 0))
LONG = 2**63 - 1


class Bounds(NamedTuple):
    """Percentages of the positive's score that a negative's must lie between."""

    low: int = 30
    high: int = 90


class Index:
    """Posting lists over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray):
        n, dim = vectors.shape
        floats = vectors.astype(np.float64)
        self.order = np.argsort(-(floats**2).sum(axis=0), kind="stable")
        self.whole = vectors
        self.values = np.ascontiguousarray(floats[:, self.order])
        self.starts = list(range(0, dim, STEP))
        self.rest = norms_from(self.values, self.starts)
        self.most = float(self.rest[0].max(initial=0.0))
        self.largest = int(abs(floats).max(initial=0)) + 1
        self.lists = []
        for c, low in enumerate(self.starts):
            rows = np.argsort(-self.rest[c], kind="stable")
            part = np.ascontiguousarray(self.values[rows, low : low + STEP])
            self.lists.append((rows, -self.rest[c][rows], part))

    def at_least(
        self, query: np.ndarray, least: float, among: np.ndarray | None
    ) -> tuple[np.ndarray, list[int]]:
        """Places of rows ``among`` the marked ones (or all) that reach ``least``, and scores."""
        q = query.astype(np.float64)[self.order]
        remaining = norms_from(q[None, :], self.starts)[:, 0]
        norm = remaining[0]
        slack = 1e-9 * norm * self.most + 1e-6
        ratio = (least - slack) / norm if norm else -math.inf
        if not norm and least > slack:
            return np.zeros(0, np.int64), []
        alive = np.ones(len(self.values), bool) if among is None else among.copy()
        if ratio > 0:
            alive &= self.rest[0] >= ratio
        reached = np.zeros(len(self.values))
        for c, low in enumerate(self.starts):
            rows, falling, part = self.lists[c]
            listed = int(np.searchsorted(falling, -ratio, side="right"))
            if not listed:
                break  # the dimensions from here on are in no list
            rows = rows[:listed]
            reached[rows] += part[:listed] @ q[low : low + STEP]
            possible = reached[rows] + remaining[c + 1] * self.rest[c + 1][rows]
            alive[rows[possible < least - slack]] = False
        places = np.flatnonzero(alive)
        scores = self.scores(places, query)
        kept = [i for i, s in enumerate(scores) if s >= least]
        return places[kept], [scores[i] for i in kept]

    def scores(self, places: np.ndarray, query: np.ndarray) -> list[int]:
        largest = int(abs(query.astype(np.float64)).max(initial=0)) + 1
        if self.largest * largest * max(1, len(query)) < 2**53:
            found = self.values[places] @ query.astype(np.float64)[self.order]
            return found.astype(np.int64).tolist()
        found = self.whole[places].astype(object) @ query.astype(object)
        return [max(-LONG - 1, min(LONG, int(s))) for s in found]

    def improve(
        self,
        query: np.ndarray,
        windows: list[tuple[int, int]],
        best: list[list],
        names: list[tuple],
        k: int,
        among: np.ndarray | None,
    ) -> None:
        """Bring ``best``, the first ``k`` rows per window so far, up to date with this index.

        It holds ``(-score, *name)`` in order, ``names`` being those of the rows.
        """
        norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        reach = math.ceil(norm * self.most * (1 + 1e-9)) + 1
        floors, tops = {}, {}
        for w, (low, high) in enumerate(windows):
            floors[w] = low if len(best[w]) < k else max(low, -best[w][-1][0])
            tops[w] = min(high, reach)
            if max(floors[w], -reach) > tops[w]:
                del floors[w], tops[w]
        for share in SHARES:
            if not floors:
                return
            goals = {}
            for w, floor in floors.items():
                floor = max(floor, -reach)
                goals[w] = floor + math.floor(share * (tops[w] - floor))
            places, scores = self.at_least(query, min(goals.values()), among)
            for w, goal in goals.items():
                found = [
                    (-s, *names[p])
                    for p, s in zip(places.tolist(), scores)
                    if goal <= s <= windows[w][1]
                ]
                known = sum(-entry[0] >= goal for entry in best[w])
                if share == 0 or len(found) + known >= k:
                    best[w] = sorted(best[w] + found)[:k]
                    del floors[w]


def norms_from(rows: np.ndarray, starts: list[int]) -> np.ndarray:
    """For each start, and for the end, the norm of each row's dimensions from there on."""
    out = np.zeros((len(starts) + 1, len(rows)))
    for c in range(len(starts) - 1, -1, -1):
        part = rows[:, starts[c] : starts[c] + STEP]
        out[c] = out[c + 1] + (part**2).sum(axis=1)
    return np.sqrt(out)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "BINARY": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields)],
        names=[name for name, _ in fields],
    )


# --- Shards and blocks of anchors -----------------------------------------------------

SHARDS = "shard BIGINT, run BIGINT, dim INT, data BINARY"
ANCHORS = "dim INT, shard BIGINT, place INT, vec_id BIGINT, label BIGINT, vector BINARY"
BLOCKS = "block BIGINT, dim INT, anchors BINARY"


class Shards(NamedTuple):
    table: DataFrame
    runs: int


def shards(vectors: DataFrame, rows: int = SHARD_ROWS) -> Shards:
    """The vectors that take part, dealt evenly and stored, and the number of runs of shards."""
    spark = vectors.sparkSession

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    ints = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows_in = vectors.where(whole & F.forall("embedding", finite)).select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), ints.alias("ints")
    )
    parts = max(1, -(-rows_in.count() // rows))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at_once = max(1, min(SHARDS_AT_ONCE, parts // tasks))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def shard(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, values = zip(*held.pop(dim))
            matrix = np.array(values, np.int64).reshape(len(ids), dim)
            data = packed(ids=np.array(ids), labels=np.array(labels), vectors=matrix)
            made += 1
            return _batch([(part << 32 | made, part // at_once, dim, data)], SHARDS)

        for batch in batches:
            for vec_id, label, value in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(len(value), []).append((vec_id, label, value))
                if len(held[len(value)]) >= rows:
                    yield shard(len(value))
        for dim in list(held):
            yield shard(dim)

    made = stored(rows_in.repartition(parts).mapInArrow(build, SHARDS), "shards")
    return Shards(made, -(-parts // at_once))


def blocks(made: DataFrame, divisor: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows whose vec_id ``divisor`` divides, with their places, in full blocks."""

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = unpacked(r["data"])
                ids, labels = held["ids"].tolist(), held["labels"].tolist()
                out = [
                    (r["dim"], r["shard"], at, ids[at], labels[at], held["vectors"][at].tobytes())
                    for at in np.flatnonzero(held["ids"] % divisor == 0).tolist()
                ]
                yield _batch(out, ANCHORS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["dim"], []).append(r)
        for k, (dim, own) in enumerate(held.items()):
            values = np.frombuffer(b"".join(r["vector"] for r in own), np.int64)
            data = packed(
                vectors=values.reshape(len(own), dim),
                **{c: np.array([r[c] for r in own]) for c in ("shard", "place", "vec_id", "label")},
            )
            yield _batch([(part << 32 | k, dim, data)], BLOCKS)

    anchors = stored(made.mapInArrow(anchors_of, ANCHORS), "anchors")
    parts = max(1, -(-anchors.count() // rows))
    return stored(anchors.repartition(parts).mapInArrow(gather, BLOCKS), "blocks")


# --- Searches -------------------------------------------------------------------------

NAMES = "block BIGINT, anchor INT, anchor_id BIGINT"
FOUND = (
    "block BIGINT, anchor INT, slot INT, vec_id BIGINT, score BIGINT, shard BIGINT, place INT"
)


def first_rows(made: Shards, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``FOUND``: the first ``k`` rows per anchor and window, of all shards together.

    ``queries`` are blocks; with ``slots`` (anchor, slot, low, high) they say what windows each
    anchor has, and without, all scores will do. Rows are of the anchor's label or of others.
    """
    limited = "slots" in queries.columns
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(made.runs - 1).cast("bigint")))
    meets = queries.withColumn("run", runs).join(made.table, ["run", "dim"])
    columns = ["block", "run", "anchors", "shard", "data", *(["slots"] if limited else [])]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, windows, best = None, {}, {}, {}

        def rows() -> pa.RecordBatch:
            out = [
                (now[0], anchor, slot, vec_id, -minus, shard, place)
                for anchor, own in best.items()
                for (slot, *_), top in zip(windows[anchor], own)
                for minus, vec_id, shard, place in top
            ]
            return _batch(out, FOUND)

        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(i)[at].as_py() for i, c in enumerate(columns)}
                if (r["block"], r["run"]) != now:
                    if now:
                        yield rows()
                    now, block = (r["block"], r["run"]), unpacked(r["anchors"])
                    windows = {i: [(0, -LONG - 1, LONG)] for i in range(len(block["vec_id"]))}
                    if limited:
                        windows = {}
                        for slot in r["slots"]:
                            own = windows.setdefault(slot["anchor"], [])
                            own.append((slot["slot"], slot["low"], slot["high"]))
                    best = {i: [[] for _ in own] for i, own in windows.items()}
                _search(r["shard"], unpacked(r["data"]), block, windows, best, k, same_label)
        if now:
            yield rows()

    found = meets.select(*columns).mapInArrow(visit, FOUND)
    order = Window.partitionBy("block", "anchor", "slot").orderBy(
        F.desc("score"), "vec_id", "shard", "place"
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(
    shard: int, held: dict, block: dict, windows: dict, best: dict, k: int, same_label: bool
) -> None:
    """Take the anchors of a block through one shard."""
    ids, labels = held["ids"].tolist(), held["labels"]
    names = [(v, shard, place) for place, v in enumerate(ids)]
    if not same_label:
        whole = Index(held["vectors"])
        others: dict[int, np.ndarray] = {}
        for i, own in windows.items():
            label = int(block["label"][i])
            if label not in others:
                others[label] = labels != label
            limits = [(low, high) for _, low, high in own]
            whole.improve(block["vectors"][i], limits, best[i], names, k, others[label])
        return
    by_label: dict[int, list[int]] = {}
    for i in windows:
        by_label.setdefault(int(block["label"][i]), []).append(i)
    for label, anchors in by_label.items():
        at = np.flatnonzero(labels == label)
        if not len(at):
            continue
        index, own_names = Index(held["vectors"][at]), [names[p] for p in at.tolist()]
        for i in anchors:
            among = None
            if block["shard"][i] == shard:
                among = at != block["place"][i]
            limits = [(low, high) for _, low, high in windows[i]]
            index.improve(block["vectors"][i], limits, best[i], own_names, k, among)


def _ceil_percent(score: Column, percent: int) -> Column:
    return -F.floor(-(score.cast("decimal(30,0)") * percent) / 100)


def mine(
    vectors: DataFrame,
    divisor: int,
    positives: int = 5,
    negatives: int = 10,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    importable(vectors.sparkSession)
    made = shards(vectors)
    queries = blocks(made.table, divisor)
    near = stored(
        first_rows(made, queries, positives, same_label=True).select(
            "block",
            "anchor",
            F.col("rank").alias("slot"),
            F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    score = F.col("positive_score")
    limits = near.select(
        "block",
        F.struct(
            "anchor",
            "slot",
            _ceil_percent(score, bounds.low).cast("bigint").alias("low"),
            F.floor(score.cast("decimal(30,0)") * bounds.high / 100).cast("bigint").alias("high"),
        ).alias("limit"),
    ).where("limit.low <= limit.high")
    slots = limits.groupBy("block").agg(F.sort_array(F.collect_list("limit")).alias("slots"))
    far = first_rows(made, queries.join(slots, "block"), negatives, same_label=False)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpacked(r["anchors"])["vec_id"].tolist()
                yield _batch([(r["block"], i, v) for i, v in enumerate(ids)], NAMES)

    named = queries.mapInArrow(ids_of, NAMES)
    return (
        far.select("block", "anchor", "slot", "rank", "vec_id", "score")
        .join(near, ["block", "anchor", "slot"])
        .join(named, ["block", "anchor"])
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives per positive of every vector whose id is divisible by 100.

    Where vec_id is divisible by 7, the label is first moved on by one of ten.
    """
    label = F.col("label")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(vectors, divisor=100)
