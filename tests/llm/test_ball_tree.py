from __future__ import annotations

import math

import numpy as np
import pytest

from adtally.llm import ball_tree
from adtally.llm.ball_tree import build_tree, top_k
from adtally.llm.queries import QUERIES
from conftest import SF_DIR
from llm_fixtures import saved  # noqa: F401

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows, divisor, k):
    taken = [
        (i, v, np.floor(256.0 * np.array(e, np.float32).astype(np.float64)).astype(np.int64))
        for i, (v, e) in enumerate(rows)
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for i, v, q in taken:
        if v % divisor == 0:
            scored = sorted(
                (-int(q @ c), w) for j, w, c in taken if j != i and len(c) == len(q)
            )
            out += [(v, rank, w, -s) for rank, (s, w) in enumerate(scored[:k], 1)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_given_vectors(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    got = result(QUERIES["op8_ball_tree_top_k"](spark, SF_DIR))
    assert got == brute([(r.vec_id, r.embedding) for r in rows], 50, 5)


@pytest.mark.parametrize("shard_rows,at_once", [(7, 2), (64, 16)])
def test_many_shards_ties_and_repeats(spark, monkeypatch, shard_rows, at_once):
    rng = np.random.default_rng(1)
    few = rng.integers(-2, 3, (6, 3)) / 256
    rows = [(int(i), few[i % 6].tolist()) for i in range(150)] + [(10, few[2].tolist())] * 12
    rows += [(3, rng.normal(size=3).tolist()) for _ in range(20)]
    monkeypatch.setattr(ball_tree, "SHARDS_AT_ONCE", at_once)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    found = ball_tree.search(ball_tree.shards(df, shard_rows), 5, 4)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("block", "dim", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    assert result(ranked) == brute(rows, 5, 4)


@pytest.mark.parametrize("least_runs,tile_queries", [(1, 9), (5, 1), (32, 10_000)])
def test_tiles_meet_once(spark, monkeypatch, least_runs, tile_queries):
    """Runs of several shards and several slices of blocks: all pairs, none twice."""
    monkeypatch.setattr(ball_tree, "LEAST_RUNS", least_runs)
    monkeypatch.setattr(ball_tree, "TILE_QUERIES", tile_queries)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.integers(-9, 9, 4 + i % 2) / 256).tolist()) for i in range(200)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    trees = ball_tree.stored(ball_tree.shards(df, 16), "trees")
    blocks = ball_tree.stored(ball_tree.home_blocks(trees, 5, 3), "blocks")
    tiles = ball_tree.tiles(trees, blocks).collect()
    held = {(t.dim, t.run, t.slice, t.number) for t in tiles if t.data is not None}
    passing = [t for t in tiles if t.data is None]
    met = [
        (t.dim, t.number, shard)
        for t in passing
        for dim, run, slice_no, shard in held
        if (dim, run, slice_no) == (t.dim, t.run, t.slice)
    ]
    shards = [(t.dim, t.shard) for t in trees.collect()]
    homes = {(b.dim, b.block) for b in blocks.collect()}
    assert sorted(met) == sorted((d, b, s) for d, b in homes for e, s in shards if d == e)
    slices = max(t.slice for t in tiles) + 1
    assert len([t for t in tiles if t.data is not None]) <= len(shards) * slices
    assert (slices == 1) == (tile_queries == 10_000)
    found = ball_tree.search(trees, 5, 3).collect()
    keys = {(f.block, f.dim, f.place, f.shard, f.shard_place) for f in found}
    assert len(found) == len(keys)
    assert result(ball_tree.top_k(df, 5, 3)) == brute(rows, 5, 3)


def test_odd_vectors(spark, saved):  # noqa: F811
    rows = [
        (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]),
        (200, [float("inf"), 1.0]), (None, [5.0, 5.0]), (1, [1.0]), (250, [2.0]), (2, []),
        (300, []), (3, [1.0, 2.0]), (4, [1e30, 1.0]), (5, [-1e30, 0.5]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).selectExpr("*", "7 AS rank")
    got = result(QUERIES["op8_ball_tree_top_k"](spark, saved(embeddings=df)))
    assert {g[0] for g in got} == {0, 250, 300}
    assert [g[2:] for g in got if g[0] == 250] == [(1, 512 * 256)]
    assert [g[2:] for g in got if g[0] == 300] == [(2, 0)]
    assert [g[2] for g in got if g[0] == 0] == [4, 3, 5]


def test_empty_table(spark, saved):  # noqa: F811
    df = spark.createDataFrame([], SCHEMA)
    assert QUERIES["op8_ball_tree_top_k"](spark, saved(embeddings=df)).collect() == []


def test_bounds_hold_for_every_node():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, (500, 8))
    tree = build_tree(rows)
    assert sorted(tree["order"]) == list(range(500))
    for (low, high), centre, radius in zip(tree["spans"], tree["centres"], tree["radii"]):
        own = rows[tree["order"][low:high]]
        assert np.sqrt(((own - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9


def test_shared_scores_open_fewer_nodes(spark):
    """A query that brings its kth score along scores fewer rows of another shard."""
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(4000, 4)) * 100).astype(np.int64)
    data = ball_tree.packed(ids=np.arange(4000), vectors=rows, **build_tree(rows))
    seen = []

    class Counting(ball_tree.Shard):
        def scores(self, low, high, *rest):
            seen.append(high - low)
            return super().scores(low, high, *rest)

    queries = rows[:20]
    alone = [[] for _ in queries]
    Counting(data).search(queries, alone, list(range(20)), 5, 0)
    blank = sum(seen)
    seen.clear()
    Counting(data).search(queries, [sorted(t) for t in alone], list(range(20)), 5, 1)
    assert sum(seen) <= blank < 20 * 4000
