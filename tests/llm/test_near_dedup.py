from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adtally.llm import common, merge_dropout, near_dedup, private_data, toxicity
from adtally.llm.graph import components
from adtally.llm.near_dedup import (
    common_counts, joining_links, keep_one, near_duplicates, shingles, small_hashes_needed,
)
from adtally.llm.queries import QUERIES
from conftest import SF_DIR
from llm_fixtures import documents, saved  # noqa: F401


def plain_shingles(text):
    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for sign in "\t\n\x0b\x0c\r":
        table[ord(sign)] = " "
    words = [w for w in (text or "").translate(table).split(" ") if w]
    n = len(words) - 4
    return {tuple(words[i : i + 5]) for i in range(n)} if n > 0 else {tuple(words)} - {()}


def brute(rows, percent):
    """``{doc_id: (size, component)}`` by comparing all texts that share a shingle."""
    sets = [plain_shingles(t) for _, t in rows]
    holders, parent = {}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        near = {}
        for s in own:
            for j in holders.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            holders[s].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op5_near_dedup"](spark, SF_DIR)
    assert result(out) == brute([(r.doc_id, r.text) for r in rows], 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def families(rng, n_words=150):
    """Copies with more and more words changed: similarities from 0.5 to 1."""
    rows = []
    for _ in range(6):
        base = [f"w{rng.integers(10_000)}" for _ in range(n_words)]
        for k in range(14):
            own = list(base)
            for at in rng.choice(n_words, k // 2, False):
                own[at] = f"x{rng.integers(10_000)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("percent,nodes", [(85, 768), (80, 3)])
def test_families_at_the_limit(spark, documents, percent, nodes, monkeypatch):  # noqa: F811
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    rows = families(np.random.default_rng(3))
    got = result(near_duplicates(documents(*rows), percent))
    assert got == brute(rows, percent)


def test_odd_rows(spark, documents, saved):  # noqa: F811
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (9, None), (8, " \n"), (7, "one two three"), (6, "ONE two\tthree"), (5, "one two"),
        (3, long), (2, long + " end"), (2, long + " end"), (None, "one two"), (None, "no match"),
        (12, "É a b c d"), (13, "é a b c d"), (20, ""), (21, "x\x1cy a b c d"),
    ]
    df = documents(*rows).selectExpr("*", "1 AS COMPONENT_ID", "2 AS node", "3 AS digest")
    out = QUERIES["op5_near_dedup"](spark, saved(documents=df)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=repr)
    assert got == sorted(
        [
            (9, 0, 9, True), (8, 0, 8, True), (20, 0, 20, True), (7, 1, 6, False),
            (6, 1, 6, True), (5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True),
            (3, 59_996, 2, False), (2, 59_997, 2, True), (2, 59_997, 2, True),
            (12, 1, 12, True), (13, 1, 13, True), (21, 1, 21, True),
        ],
        key=repr,
    )
    kept = keep_one(df, 85)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, 2, 5, 6, 8, 9, 12, 13, 20, 21]


def test_empty_table(spark, documents, saved):  # noqa: F811
    empty = documents((1, "x")).where("false")
    assert QUERIES["op5_near_dedup"](spark, saved(documents=empty)).collect() == []
    assert keep_one(empty).collect() == []


@given(st.text(alphabet=" aAbB\t\n\x0b\x1c\x85éÉ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_shingles_are_those_of_the_words(text):
    assert len(shingles(text.encode())) == len(plain_shingles(text))


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_common_counts_of_blocks(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 400))

    def block():
        return [
            np.unique(rng.integers(0, size, rng.integers(0, 60)).astype(np.uint64))
            for _ in range(rng.integers(0, 40))
        ]

    left, right = block(), block()
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert common_counts(left, right).tolist() == want


def test_blocks_return_a_forest():
    same = np.arange(100, dtype=np.uint64)
    nodes = [(i, i, same) for i in range(50)]
    assert len(joining_links(nodes, nodes, 85)) == 49
    assert joining_links(nodes[:2], [(9, 9, same + np.uint64(1000))], 85) == []


def test_pairs_at_the_limit_are_rarely_missed():
    for percent in (80, 85):
        n = small_hashes_needed(percent)
        assert 2 * (1 - (percent / 100) ** near_dedup.PER_KEY) ** n <= near_dedup.MISS


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(1)
    pairs = [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(90)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(pairs, "u BIGINT, v BIGINT")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(df.where("false")).collect() == []


def test_keys_are_counted_in_small_tasks(spark, documents, monkeypatch):  # noqa: F811
    """Tasks of bounded tables, and the same shared keys in one task or in many."""
    each = small_hashes_needed(85) ** 2
    docs = documents(*families(np.random.default_rng(5)), (900, None))
    nodes = near_dedup.sketched(docs, 85).where("digest IS NOT NULL").select(
        "a", "b", F.monotonically_increasing_id().alias("node")
    )
    nodes = nodes.localCheckpoint()
    whole = sorted(near_dedup.shared_keys(nodes, each).collect())
    holders = {}
    for row in near_dedup.table_keys(nodes).collect():
        holders.setdefault(row.key, set()).add(row.node)
    assert whole == sorted((k, min(own)) for k, own in holders.items() if len(own) > 1)
    assert len(whole) > 0 and sum(r.n for r in nodes.selectExpr("size(a) * size(b) AS n").collect()) == each * 84
    monkeypatch.setattr(near_dedup, "KEYS_A_TASK", 10 * each)
    parts = near_dedup.dealt(nodes, each).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 40
    assert sorted(near_dedup.shared_keys(nodes, each).collect()) == whole


@pytest.fixture
def arrow_rows(spark):
    """Sets the rows of a batch; the session's own number comes back after the test."""
    before = spark.conf.get(common.ARROW_ROWS)
    yield lambda n: spark.conf.set(common.ARROW_ROWS, str(n))
    spark.conf.set(common.ARROW_ROWS, before)


@pytest.mark.parametrize("given_rows, left", [(10_000, 1_000), (0, 1_000), (-1, 1_000), (50, 50)])
def test_workers_get_few_rows_at_once(spark, documents, arrow_rows, given_rows, left):  # noqa: F811
    """Each map over whole texts bounds its batches, and leaves smaller ones as they are."""
    docs = documents(*((k, f"one two three four five {k}") for k in range(2_500))).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    for each in (
        lambda: near_dedup.sketched(docs, 80),
        lambda: near_dedup.with_digest(docs, "digest"),
        lambda: toxicity.keep_clean(docs, None),
        lambda: private_data.redact(docs, None),
        lambda: merge_dropout.encode_documents(docs, merge_dropout.model_path()),
    ):
        arrow_rows(given_rows)
        each()
        got = [r.n for r in docs.mapInArrow(sizes, "n BIGINT").collect()]
        assert max(got) == left and sum(got) == 2_500


def test_rows_of_a_batch_change_nothing(spark, documents, arrow_rows):  # noqa: F811
    """The same classes and documents, in batches of seven rows too; blocks span batches."""
    docs = documents(*families(np.random.default_rng(11)), (900, None), (901, ""))
    found = []
    for n in (10_000, 7):
        arrow_rows(n)
        found.append((result(near_duplicates(docs, 80)), sorted(keep_one(docs).collect())))
    assert found[0] == found[1]


def test_a_task_leaves_no_words_behind(spark, documents):  # noqa: F811
    """The table of words is empty when a task's rows are through."""
    docs = documents(*((k, f"one two three four five {k}") for k in range(40))).coalesce(1)

    def held(batches):
        for batch in batches:
            words = len(common._word_hashes)
            yield pa.RecordBatch.from_pydict({"n": pa.array([words], pa.int64())})

    for df in (near_dedup.sketched(docs, 80), near_dedup.with_digest(docs, "digest")):
        assert df.count() == 40
        spread = spark.range(64).repartition(16).mapInArrow(held, "n BIGINT")
        assert {r.n for r in spread.collect()} == {0}
