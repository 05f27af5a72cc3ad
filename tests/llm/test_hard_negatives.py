from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from llm_fixtures import saved  # noqa: F401

from adtally.llm import hard_negatives
from adtally.llm.hard_negatives import Bounds, Index, mine

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT"
LONG = 2**63 - 1


@pytest.fixture
def vectors(spark):
    def make(rows, parts=3):
        return spark.createDataFrame(list(rows), SCHEMA).repartition(parts)

    return make


def plain(rows, divisor, positives=5, negatives=10, bounds=Bounds()):
    """Every anchor against every row."""
    good = [
        (v, [math.floor(256 * c) for c in e], lab)
        for v, e, lab in rows
        if v is not None and lab is not None and e is not None
        and all(c is not None and math.isfinite(c) for c in e)
    ]
    out = Counter()
    for a, (anchor, x, label) in enumerate(good):
        if anchor % divisor:
            continue
        scored = sorted(
            (-max(-LONG - 1, min(LONG, sum(p * q for p, q in zip(x, y)))), v, lab == label)
            for b, (v, y, lab) in enumerate(good)
            if b != a and len(x) == len(y)
        )
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            inside = [
                s for s in scored
                if not s[2] and bounds.low * -p <= 100 * -s[0] <= bounds.high * -p
            ]
            for rank, (n, negative, _) in enumerate(inside[:negatives], 1):
                out[anchor, positive, rank, negative, -p, -n] += 1
    return out


def same(df, rows, divisor, **more):
    got = Counter(tuple(r) for r in df.collect())
    want = plain(rows, divisor, **more)
    assert got == want
    return len(want)


def drawn(n, dim, labels, seed=1, grain=1.0):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=(n, dim)) / grain) * grain
    return [(k, v.tolist(), int(rng.integers(labels))) for k, v in enumerate(values)]


@pytest.mark.parametrize("dim", [1, 16, 40])
@pytest.mark.parametrize("grain", [0.01, 1.0])
def test_equals_brute_force(vectors, dim, grain):
    rows = drawn(300, dim, 4, grain=grain)  # a coarse grain has many ties
    assert same(mine(vectors(rows), 7), rows, 7) > 50


def test_many_shards_and_blocks(vectors, monkeypatch, conf):
    monkeypatch.setattr(hard_negatives, "SHARDS_AT_ONCE", 3)
    conf(spark__sql__shuffle__partitions="2")
    rows = drawn(400, 8, 3, seed=2)
    made = hard_negatives.shards
    monkeypatch.setattr(hard_negatives, "shards", lambda df: made(df, 40))
    gathered = hard_negatives.blocks
    monkeypatch.setattr(hard_negatives, "blocks", lambda df, divisor: gathered(df, divisor, 9))
    assert same(mine(vectors(rows), 5), rows, 5) > 50


def test_other_counts_and_bounds(vectors):
    rows = drawn(200, 6, 2, seed=3)
    more = {"positives": 2, "negatives": 3, "bounds": Bounds(10, 99)}
    assert same(mine(vectors(rows), 10, **more), rows, 10, **more) > 20


def test_hot_label_and_copies(vectors):
    rows = drawn(150, 6, 3, seed=4)
    rows += [(1_000 + k, rows[0][1], 0) for k in range(150)]
    rows += [(2_000 + k, [c * 0.8 for c in rows[0][1]], 1) for k in range(60)]
    assert same(mine(vectors(rows), 50), rows, 50) > 10


def test_scores_beyond_doubles_are_exact(vectors):
    rows = [(k, [c * 1e7 + k for c in v], lab) for k, v, lab in drawn(80, 4, 2, seed=5)]
    assert same(mine(vectors(rows), 4), rows, 4) > 10
    rows = [(k, [c * 1e11 for c in v], lab) for k, v, lab in drawn(60, 3, 2, seed=6)]
    same(mine(vectors(rows), 4), rows, 4)


def test_odd_rows(vectors):
    rows = drawn(60, 3, 2, seed=7) + [
        (None, [1.0, 1.0, 1.0], 0), (100, None, 0), (101, [1.0, None, 1.0], 0),
        (102, [math.nan, 1.0, 1.0], 1), (103, [math.inf, 1.0, 1.0], 1), (104, [1.0, 1.0, 1.0], None),
        (105, [], 0), (110, [], 0), (106, [], 1), (107, [2.0], 0), (115, [3.0], 0), (108, [1.0], 1),
        (120, [0.0, 0.0, 0.0], 0), (120, [0.0, 0.0, 0.0], 0), (125, [1.0, 2.0, 3.0], 9),
    ]
    repeated = rows + [rows[5], rows[5], rows[10]]
    clash = vectors(repeated).selectExpr("*", "1 AS shard", "2 AS run", "3 AS place", "4 AS rank")
    assert same(mine(clash, 5), repeated, 5) > 10


def test_nothing_to_mine(vectors):
    assert mine(vectors([]), 10).collect() == []
    assert mine(vectors([(1, [1.0], 0), (2, [1.0], 1)]), 10).collect() == []  # no anchor
    assert mine(vectors([(10, [1.0], 0), (2, [1.0], 1)]), 10).collect() == []  # no positive
    assert mine(vectors([(10, [1.0], 0), (2, [-1.0], 0), (3, [1.0], 1)]), 10).collect() == []


def test_lists_end_where_norms_do():
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(500, 48)) * 256 * np.linspace(4, 0.1, 48)).astype(np.int64)
    index, query = Index(vectors), vectors[3]
    exact = vectors @ query
    for least in (int(exact.max()), int(np.sort(exact)[-20]), 0, -(10**12)):
        places, scores = index.at_least(query, least, None)
        assert sorted(places) == np.flatnonzero(exact >= least).tolist()
        assert scores == exact[places].tolist()
    norm = np.sqrt((query.astype(float) ** 2).sum())
    ratio = int(np.sort(exact)[-20]) / norm
    listed = [int(np.searchsorted(falling, -ratio, side="right")) for _, falling, _ in index.lists]
    assert listed[-1] < listed[0] <= 500  # the last dimensions are left out for most rows


def test_query(spark):
    given = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = [
        (r.vec_id, [float(c) for c in r.embedding], (r.label + (r.vec_id % 7 == 0)) % 10)
        for r in given
    ]
    assert same(hard_negatives.op13_hard_negatives(spark, SF_DIR), rows, 100) > 0
