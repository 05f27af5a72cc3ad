"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are scaled to integers and dealt evenly into shards of at most ``SHARD_ROWS``. Each
shard's ball tree is built once and stored. A block of queries first searches the shard it
came from; the kth scores found there, and every better one met on the way, bound the search
in the other shards: a node is opened only if its centre and radius allow a score that is
not below the query's current kth.

Blocks meet shards in tiles: a task holds the trees of a run of shards and lets many blocks
pass by. A tree is thus sent once for every ``TILE_QUERIES`` queries, not once a block, and
a block, the smaller of the two by far, once a run of shards.

Rows: a vector takes no part if it is null, holds a null or a component that is not finite,
or has no vec_id. An empty vector has score 0 with its like. Only vectors of equal length
meet. Repeated rows are rows of their own: each is a query and a candidate, and a query's own
row is the only one that it does not meet. Ties go to the smaller vec_id. Components beyond
64 bits are clipped, and so are scores. An empty table gives no rows. Only vec_id and
embedding are read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtally.llm.common import importable, stored, table

SHARD_ROWS = 8_192
LEAF_ROWS = 48
#: Shards that one task holds and takes a block of queries through, handing on its kth scores;
#: fewer as long as there are not this many runs of them.
SHARDS_AT_ONCE, LEAST_RUNS = 16, 32
#: Queries, in blocks, that pass by the trees of one task, and components of vectors that it
#: holds, so that runs of long vectors are shorter.
TILE_QUERIES, HELD_VALUES = 16_384, 2**24
SCALE = 256.0
LONG = 2**63 - 1


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def build_tree(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes over ``order``, a permutation of the rows: span, children, centre and radius."""
    rows = vectors.astype(np.float64)
    order = np.arange(len(rows))
    spans, children, centres, radii = [], [], [], []

    def grow(low: int, high: int) -> int:
        own = rows[order[low:high]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(spans)
        spans.append((low, high))
        children.append((-1, -1))
        centres.append(centre)
        radii.append(away.max())
        if high - low > LEAF_ROWS and away.max() > 0:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            along = np.argsort(own @ (far - other), kind="stable")
            order[low:high] = order[low:high][along]
            mid = (low + high) // 2
            children[node] = (grow(low, mid), grow(mid, high))
        return node

    grow(0, len(rows))
    return {
        "order": order,
        "spans": np.array(spans),
        "children": np.array(children),
        "centres": np.array(centres),
        "radii": np.array(radii),
    }


class Shard:
    """One shard's vectors in the order of their tree."""

    def __init__(self, data: bytes):
        held = unpacked(data)
        self.tree = held
        self.ids = held["ids"][held["order"]]
        self.place = held["order"]
        self.vectors = held["vectors"][held["order"]]
        self.floats = self.vectors.astype(np.float64)
        self.largest = int(abs(self.floats).max(initial=0)) + 1

    def scores(self, low: int, high: int, query: np.ndarray, exact_floats: bool):
        if exact_floats:
            return (self.floats[low:high] @ query.astype(np.float64)).astype(np.int64).tolist()
        rows = self.vectors[low:high].astype(object)
        return [max(-LONG - 1, min(LONG, int(s))) for s in rows @ query.astype(object)]

    def search(
        self, queries: np.ndarray, best: list[list], own: list[int | None], k: int, shard: int
    ) -> None:
        """Improve ``best`` by this shard's rows.

        It holds a heap per query, of (score, -vec_id, shard, place in the shard).
        """
        if not len(self.ids):
            return
        tree, floats = self.tree, queries.astype(np.float64)
        norms = np.sqrt((floats**2).sum(axis=1, keepdims=True))
        centred = floats @ tree["centres"].T
        bounds = centred + norms * tree["radii"]
        bounds += 1e-9 * (abs(centred) + norms * tree["radii"]) + 1e-6
        spans, children = tree["spans"].tolist(), tree["children"].tolist()
        for i, query in enumerate(queries):
            top, bound = best[i], bounds[i].tolist()
            safe = int(abs(floats[i]).max(initial=0)) + 1
            exact = self.largest * safe * max(1, len(query)) < 2**53
            nodes = [(-bound[0], 0)]
            while nodes:
                upper, node = heapq.heappop(nodes)
                if len(top) == k and -upper < top[0][0]:
                    break
                left, right = children[node]
                if left >= 0:
                    heapq.heappush(nodes, (-bound[left], left))
                    heapq.heappush(nodes, (-bound[right], right))
                    continue
                low, high = spans[node]
                for at, score in enumerate(self.scores(low, high, query, exact), low):
                    if len(top) == k and score < top[0][0] or self.place[at] == own[i]:
                        continue
                    found = (score, -int(self.ids[at]), shard, int(self.place[at]))
                    if len(top) < k:
                        heapq.heappush(top, found)
                    elif found > top[0]:
                        heapq.heapreplace(top, found)


def shards(vectors: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """``(shard, dim, data)`` of trees over the vectors that take part."""
    importable(vectors.sparkSession)

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    ints = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    whole = F.col("vec_id").isNotNull() & F.forall("embedding", finite)
    rows_in = vectors.where(whole).select(F.col("vec_id").cast("bigint"), ints.alias("ints"))
    parts = max(1, -(-rows_in.count() // rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def tree(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, values = zip(*held.pop(dim))
            matrix = np.array(values, np.int64).reshape(len(ids), dim)
            data = packed(ids=np.array(ids, np.int64), vectors=matrix, **build_tree(matrix))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([dim], pa.int32()), pa.array([data])],
                names=["made", "dim", "data"],
            )

        for batch in batches:
            for vec_id, value in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(len(value), []).append((vec_id, value))
                if len(held[len(value)]) >= rows:
                    yield tree(len(value))
        for dim in list(held):
            yield tree(dim)

    made = stored(
        rows_in.repartition(parts).mapInArrow(build, "made BIGINT, dim INT, data BINARY"), "trees"
    )
    # One row per shard, of thousands of vectors; the trees stay where they are.
    place = F.row_number().over(Window.partitionBy("dim").orderBy("made"))
    numbers = made.select("made", "dim", (place - 1).alias("shard"))
    return made.join(numbers, ["made", "dim"]).select("shard", "dim", "data")


FOUND = (
    "block INT, dim INT, place INT, query_id BIGINT, vec_id BIGINT, score BIGINT, "
    "shard INT, shard_place INT"
)


def home_blocks(trees: DataFrame, divisor: int, k: int) -> DataFrame:
    """``(block, dim, n, queries)``: each shard's own queries with what they find in it."""

    def queries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, dim, data = (c[row].as_py() for c in batch.columns)
                home = unpacked(data)
                at = np.flatnonzero(home["ids"] % divisor == 0)
                if not len(at):
                    continue
                queries, best = home["vectors"][at], [[] for _ in at]
                Shard(data).search(queries, best, at.tolist(), k, number)
                seeds = [(i, *found) for i, top in enumerate(best) for found in top]
                block = packed(
                    ids=home["ids"][at],
                    places=at,
                    vectors=queries,
                    seeds=np.array(seeds, np.int64).reshape(-1, 5),
                )
                ints = [pa.array([x], pa.int32()) for x in (number, dim, len(at))]
                yield pa.RecordBatch.from_arrays(
                    [*ints, pa.array([block])], names=["block", "dim", "n", "queries"]
                )

    return trees.select("shard", "dim", "data").mapInArrow(
        queries_of, "block INT, dim INT, n INT, queries BINARY"
    )


def tiles(trees: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(dim, run, slice, number, queries, data)``: trees and blocks, each in all its tiles.

    Runs and slices are told by numbers and counts, one row per shard.
    """
    before = Window.partitionBy("dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slice_no = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / TILE_QUERIES).cast("int")
    sliced = blocks.select("dim", "block", slice_no.alias("slice"))
    shards_of = trees.groupBy("dim").agg(F.count(F.lit(1)).alias("shards"))
    fitting = F.lit(HELD_VALUES // SHARD_ROWS) / F.greatest(F.col("dim"), F.lit(1))
    per_run = F.least(F.lit(SHARDS_AT_ONCE), F.ceil(F.col("shards") / LEAST_RUNS), fitting)
    per_run = F.greatest(F.floor(per_run), F.lit(1)).cast("int")
    runs_of = shards_of.select("dim", per_run.alias("per_run"), F.expr("shards - 1").alias("top"))
    slices_of = sliced.groupBy("dim").agg(F.max("slice").alias("top"))

    run = F.floor(F.col("shard") / F.col("per_run")).cast("int")
    places = trees.select("dim", "shard").join(runs_of, "dim").join(
        slices_of.withColumnRenamed("top", "last"), "dim"
    )
    tree_seats = places.select(
        "dim", "shard", run.alias("run"), F.explode(F.expr("sequence(0, last)")).alias("slice")
    )
    last_run = F.floor(F.col("top") / F.col("per_run")).cast("int")
    block_seats = sliced.join(runs_of, "dim").select(
        "dim", "block", "slice", F.explode(F.sequence(F.lit(0), last_run)).alias("run")
    )
    none = F.lit(None).cast("binary")
    held = trees.join(tree_seats, ["dim", "shard"]).select(
        "dim", "run", "slice", F.col("shard").alias("number"), none.alias("queries"), "data"
    )
    passing = blocks.join(block_seats, ["dim", "block"]).select(
        "dim", "run", "slice", F.col("block").alias("number"), "queries", none.alias("data")
    )
    return held.unionAll(passing)


def search(trees: DataFrame, divisor: int, k: int) -> DataFrame:
    """The ``k`` best per query and run of shards, for queries whose vec_id ``divisor`` divides.

    Each run gives rows of its own shards only, so no row comes out twice. What a query found
    in its own shard goes with it to every run.
    """
    spark = trees.sparkSession
    trees = stored(trees, "shards")
    blocks = stored(home_blocks(trees, divisor, k), "blocks")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def rows(number: int, dim: int, block: dict, best: list[list]) -> pa.RecordBatch:
            out = [
                (number, dim, int(block["places"][i]), int(block["ids"][i]), -v, s, shard, place)
                for i, top in enumerate(best)
                for s, v, shard, place in top
                if shard in held
            ]
            types = [*[pa.int32()] * 3, *[pa.int64()] * 3, *[pa.int32()] * 2]
            cols = zip(*out) if out else [[]] * len(types)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=[c.split()[0] for c in FOUND.split(", ")],
            )

        for batch in batches:
            for row in range(batch.num_rows):
                dim, run, slice_no, number, queries, data = (c[row].as_py() for c in batch.columns)
                if (dim, run, slice_no) != now:
                    now, held = (dim, run, slice_no), {}
                if data is not None:
                    held[number] = Shard(data)
                    continue
                block = unpacked(queries)
                best: list[list] = [[] for _ in block["ids"]]
                for i, *found in block["seeds"].tolist():
                    heapq.heappush(best[i], tuple(found))
                for shard, tree in held.items():
                    if shard != number:
                        tree.search(block["vectors"], best, [None] * len(best), k, shard)
                yield rows(number, dim, block, best)

    return (
        tiles(trees, blocks)
        .repartition(tasks, "dim", "run", "slice")
        .sortWithinPartitions("dim", "run", "slice", F.col("data").isNull(), "number")
        .mapInArrow(visit, FOUND)
    )


def top_k(vectors: DataFrame, divisor: int, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``, ranks from 1, ties to the smaller vec_id."""
    found = search(shards(vectors), divisor, k)
    order = Window.partitionBy("block", "dim", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), divisor=50, k=5)
