"""Whitening of embeddings by shifted CholeskyQR.

The centred rows are factored into orthonormal columns and a triangle, pass by pass over the
table: a pass sums the Gram matrix of the rows solved by all former triangles, and its Cholesky
factor is the next triangle. The first one is shifted, so that it exists however ill-conditioned
the rows are; later ones mend what the shift left, until the columns are orthonormal. The
product of the triangles has the singular values and right vectors of the rows themselves, so
no covariance is ever factored, and nothing of the size of the table leaves the tasks: a task
gives one matrix, ``FAN_IN`` of them are summed at a time, and the driver adds the last few.

Components are scaled to integers first, and centred as ``n * x - sum``, exactly, before a
division by ``n``.

Rows: a vector takes no part if it is null, is empty, or holds a null or a component that is not
finite. If vectors differ in length, those of the commonest length (of the longer ones, if
several are) are the table, and the others take no part. A null vec_id stays null; repeated rows
and ids are rows of their own, and ties of eigenvalues leave the choice within their space open.
Scaled components beyond ``2**40`` are clipped to it. A direction without variance (below
``NO_VARIANCE`` of the largest deviation) has no rows, so a table of equal vectors, or of one,
gives none, and an empty table none. ``deviation`` is clipped to 64 bits; ``deviation_text`` has
all digits. Only vec_id and embedding are read; other columns do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.common import importable, stored, table

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: Matrices of tasks that are summed in one.
FAN_IN = 64
#: Passes over the rows at most; three are usual.
PASSES = 8
#: Columns are orthonormal when the Gram matrix is this close to the identity.
CLOSE = 1e-9
#: Deviations below this share of the largest one are rounding.
NO_VARIANCE = 1e-12
UNIT = 2.0**-53
LARGEST = 2**40
LONG = 2**63 - 1

Total = Callable[[Iterator[np.ndarray]], object]


class Fit(NamedTuple):
    n: int
    sums: list[int]
    largest: int
    components: np.ndarray  # one per row, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


def scaled(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part, stored."""

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def whole(x):
        most = F.lit(float(LARGEST))
        near = F.greatest(F.least(SCALE * x.cast("double"), most), -most)
        return F.floor(near).cast("bigint") + OFFSET

    size = F.size("embedding")
    rows = vectors.where((size > 0) & F.forall("embedding", finite))
    counts = rows.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = counts.orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.where(size == (common["size"] if common else 0))
    ints = F.transform("embedding", whole).alias("x")
    return stored(rows.select(F.col("vec_id").cast("bigint"), ints), "scaled")


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def total(rows: DataFrame, part: Total, add: Callable[[object, object], object]):
    """``part`` of the integer matrices of each task, summed up by ``add`` over all tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pickled(part(_matrix(b) for b in batches if b.num_rows))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pickle.loads(v) for b in batches for v in b.column(0).to_pylist()]
        if parts:
            yield _pickled(reduce(add, parts))

    parts = stored(rows.select("x").mapInArrow(first, "part BINARY"), "parts")
    count = parts.count()
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        parts = stored(parts.repartition(count).mapInArrow(fold, "part BINARY"), "parts")
    held = [pickle.loads(r.part) for r in parts.collect()]
    return reduce(add, held, None)


def _pickled(value: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)])], names=["part"])


def _either(add: Callable) -> Callable:
    """``add`` where both sides are there; a task without rows gives None."""
    return lambda a, b: b if a is None else a if b is None else add(a, b)


def sums(rows: DataFrame) -> tuple[int, list[int], int] | None:
    """The number of rows, the exact sum of each component, and the largest size of one."""

    def part(matrices: Iterable[np.ndarray]):
        n, found, largest = 0, None, 0
        for m in matrices:
            for low in range(0, len(m), 1 << 20):  # sums of so many rows fit 64 bits
                own = m[low : low + (1 << 20)].sum(axis=0).tolist()
                found = own if found is None else [a + b for a, b in zip(found, own)]
            n, largest = n + len(m), max(largest, int(abs(m).max()))
        return None if found is None else (n, found, largest)

    def add(a, b):
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])], max(a[2], b[2])

    return total(rows, part, _either(add))


def deviations(x: np.ndarray, n: int, of: list[int], largest: int) -> np.ndarray:
    """``n * x - of`` exactly: 64-bit integers where they fit, else Python's."""
    if 2 * n * largest < LONG:
        return n * x - np.array(of, np.int64)
    return n * x.astype(object) - np.array(of, object)


def solved(rows: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """The rows Q with ``Q @ triangle == rows``, for an upper triangle."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return out


def triangle_of(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The Cholesky factor of a Gram matrix; shifted if asked, or if there is none without."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    largest = max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * largest
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(rows: DataFrame) -> Fit | None:
    """Mean, components and eigenvalues of the scaled rows; None if there is no row."""
    found = sums(rows)
    if found is None:
        return None
    n, of, largest = found
    triangles: list[np.ndarray] = []
    trace = 0.0
    for _ in range(PASSES):
        known = list(triangles)

        def part(matrices: Iterable[np.ndarray]):
            gram = None
            for m in matrices:
                q = deviations(m, n, of, largest).astype(np.float64) / n
                for triangle in known:
                    q = solved(q, triangle)
                gram = q.T @ q if gram is None else gram + q.T @ q
            return gram

        gram = total(rows, part, _either(np.add))
        if not triangles:
            trace = float(np.trace(gram)) / n
        triangles.append(triangle_of(gram, n, shifted=not triangles))
        live = np.flatnonzero(np.diag(gram) > 0.5)
        off = abs(gram[np.ix_(live, live)] - np.eye(len(live))).max(initial=0)
        if len(triangles) > 2 and off < CLOSE:
            break
    _, values, right = np.linalg.svd(reduce(lambda a, b: b @ a, triangles))
    keep = values > NO_VARIANCE * values[0] if trace > 0 else np.zeros(len(values), bool)
    signs = np.sign(right[np.arange(len(right)), abs(right).argmax(axis=1)])
    right = right * signs[:, None]
    return Fit(n, of, largest, right[keep], values[keep] ** 2 / n, trace)


def whiten(rows: DataFrame, model: Fit, components: int = COMPONENTS) -> DataFrame:
    """Each scaled row on the first components, and how well all rows are whitened."""
    n, of, largest = model.n, model.sums, model.largest
    directions = model.components[:components]
    roots = np.sqrt(model.eigenvalues[:components])
    k = len(directions)
    explained = model.eigenvalues[:components] / (model.trace or 1.0)
    if not k:
        directions, roots = np.zeros((0, len(of))), np.zeros(0)

    def white(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = deviations(x, n, of, largest)
        return exact, exact.astype(np.float64) / n @ directions.T / roots

    def part(matrices: Iterable[np.ndarray]):
        found = None
        for m in matrices:
            w = np.hstack([white(m)[1], np.ones((len(m), 1))])
            found = w.T @ w if found is None else found + w.T @ w
        return found

    error = 0.0
    if k:
        gram = total(rows, part, _either(np.add)) / n
        covariance = gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k])
        error = float(abs(covariance - np.eye(k)).max())
    schema = (
        "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, "
        "explained DOUBLE, identity_error DOUBLE, deviation_text STRING"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            exact, values = white(_matrix(batch))
            if 4 * exact.shape[1] * (n * largest) ** 2 < LONG:
                squares = (exact**2).sum(axis=1).tolist()
            else:
                squares = [sum(v * v for v in row) for row in exact.tolist()]
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            rows_out = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_out)),
                    pa.array(np.full(rows_out * k, n, np.int64)),
                    pa.array([min(s, LONG) for s in squares], pa.int64()).take(each),
                    pa.array(values.ravel()),
                    pa.array(np.tile(explained, rows_out)),
                    pa.array(np.full(rows_out * k, error)),
                    pa.array([str(s) for s in squares]).take(each),
                ],
                names=names,
            )

    return rows.select("vec_id", "x").mapInArrow(out, schema)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text)``."""
    importable(vectors.sparkSession)
    rows = scaled(vectors)
    model = fit(rows)
    if model is None:
        model = Fit(0, [], 0, np.zeros((0, 0)), np.zeros(0), 0.0)
    return whiten(rows, model, components)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first eight whitening components."""
    return whitened(table(spark, sf_dir, "embeddings"))
