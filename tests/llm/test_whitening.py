from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SF_DIR
from llm_fixtures import saved  # noqa: F401

from adtally.llm import whitening

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>"


@pytest.fixture
def vectors(spark):
    def make(rows, parts=3):
        return spark.createDataFrame(list(rows), SCHEMA).repartition(parts)

    return make


def plain(rows):
    """The same by an eigendecomposition of the covariance of exact deviations."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    exact = len(x) * x - x.sum(axis=0)
    centred = exact.astype(float) / len(x)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    live = min(whitening.COMPONENTS, int((values > 1e-9 * values[0]).sum()))
    white = centred @ vectors[:, :live] / np.sqrt(values[:live])
    return white, values[:live] / values.sum(), [sum(int(v) ** 2 for v in r) for r in exact]


def compare(df, rows):
    white, explained, squares = plain(rows)
    got = df.toPandas()
    place = {vec_id: i for i, (vec_id, _) in enumerate(rows)}
    assert len(got) == white.size and set(got.n) == {len(rows)}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-4
    for k in range(white.shape[1]):
        own = got[got.component == k + 1]
        at = [place[v] for v in own.vec_id]
        theirs = white[at, k]
        sign = np.sign((own.whitened * theirs).sum())
        assert np.allclose(own.whitened * sign, theirs, atol=1e-6, rtol=1e-6)
        assert np.allclose(own.explained, explained[k], rtol=1e-8)
        assert own.deviation_text.tolist() == [str(squares[i]) for i in at]
        assert own.deviation.tolist() == [min(squares[i], 2**63 - 1) for i in at]


def drawn(n, dim, seed=1, scale=None):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, dim)) * (np.linspace(3, 0.2, dim) if scale is None else scale)
    return [(k, v.tolist()) for k, v in enumerate(values)]


@pytest.mark.parametrize("dim", [1, 3, 12])
def test_equals_an_eigendecomposition(vectors, dim):
    rows = drawn(400, dim)
    compare(whitening.whitened(vectors(rows)), rows)


def test_ill_conditioned_columns(vectors):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 6)) * 100
    near = base[:, :3] + rng.normal(size=(500, 3)) * 0.02
    rows = [(k, v.tolist()) for k, v in enumerate(np.hstack([base, near]))]
    compare(whitening.whitened(vectors(rows)), rows)


def test_columns_without_variance_or_repeated(vectors):
    rows = [(k, [*v, 5.0, v[0], 0.0]) for k, v in drawn(200, 4)]
    compare(whitening.whitened(vectors(rows)), rows)


def test_fewer_rows_than_dimensions(vectors):
    rows = drawn(5, 20)
    compare(whitening.whitened(vectors(rows)), rows)


def test_sums_beyond_64_bits(vectors):
    rows = drawn(300, 3, scale=np.array([1e8, 1e7, 3e6]))
    compare(whitening.whitened(vectors(rows)), rows)
    x = np.array([[2**40, -(2**40)], [1, 2]])
    exact = whitening.deviations(x, 2**25, [5, 2**65], 2**40)
    assert exact.tolist() == [[2**65 - 5, -(2**65) - 2**65], [2**25 - 5, 2**26 - 2**65]]


def test_many_tasks_are_summed_in_steps(vectors, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = drawn(120, 4)
    compare(whitening.whitened(vectors(rows, parts=29)), rows)


def test_triangles_are_solved():
    rng = np.random.default_rng(2)
    triangle = np.triu(rng.normal(size=(7, 7))) + 4 * np.eye(7)
    rows = rng.normal(size=(30, 7))
    assert np.allclose(whitening.solved(rows, triangle) @ triangle, rows)
    gram = rows.T @ rows
    factor = whitening.triangle_of(gram, 30, shifted=False)
    assert np.allclose(factor.T @ factor, gram) and np.allclose(factor, np.triu(factor))


def test_odd_rows(spark, vectors):
    good = drawn(50, 3)
    odd = [
        (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, math.nan, 2.0]),
        (94, [math.inf, 1.0, 2.0]), (95, [1.0, 2.0]), (96, [1.0, 2.0, 3.0, 4.0]),
    ]
    clash = vectors(good + odd).selectExpr("*", "embedding AS x", "vec_id AS n", "1 AS component")
    compare(whitening.whitened(clash), good)
    repeated = good + [(None, good[0][1]), good[1]]
    got = whitening.whitened(vectors(repeated)).where("component = 1").collect()
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == sorted([*range(50), 1])
    assert {r.n for r in got} == {52} and sum(r.vec_id is None for r in got) == 1


def test_no_variance_and_empty(vectors):
    assert whitening.whitened(vectors([(k, [1.0, 2.0]) for k in range(9)])).collect() == []
    assert whitening.whitened(vectors([(1, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(vectors([])).collect() == []
    far = [(1, [1e300, 0.0]), (2, [-1e300, 1.0])]
    assert {r.n for r in whitening.whitened(vectors(far)).collect()} == {2}


def test_query(spark):
    given = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in given]
    compare(whitening.op12_embedding_whitening(spark, SF_DIR), rows)
