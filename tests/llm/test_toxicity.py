from __future__ import annotations

import zlib

import numpy as np
import pytest

from adtally.llm import toxicity
from adtally.llm.queries import QUERIES
from adtally.llm.toxicity import features_of, margins, nn_risk, train, train_one
from llm_fixtures import documents, saved  # noqa: F401

LABELS = "doc_id BIGINT, quality INT, toxic INT"
SF = "/root/testdata/sf0.01"


def out_of_sample(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores))
    bad = np.array(labels) == 1
    return (ranks[bad].sum() - bad.sum() * (bad.sum() - 1) / 2) / (bad.sum() * (~bad).sum())


def test_held_out_documents(spark):
    """Given rows: better than the share of clean texts, and no clean one rejected."""
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == out_of_sample(d) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    rows = [(got[x.doc_id], x.toxic) for x in labels if out_of_sample(x.doc_id)]
    right = np.mean([r.predicted == y for r, y in rows])
    assert right > 0.95 > 1 - np.mean([y for _, y in rows])
    assert auc([r.score for r, _ in rows], [y for _, y in rows]) > 0.85
    assert not [r for r, y in rows if r.predicted and not y]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_tables_of_all_sizes_teach(spark, scale):
    """Held-out labels by area under the curve; on the smallest table, no constant score."""
    folder = f"/root/testdata/{scale}"
    got = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(got[x.doc_id], x.toxic) for x in labels if out_of_sample(x.doc_id)]
    assert auc(*zip(*held)) > (0.9 if scale == "sf0.001" else 0.95)
    assert len(set(got.values())) > 0.3 * len(got)
    rejected = sum(s >= 0.5 for s, toxic in held if not toxic)
    assert rejected <= 1


def made(rng, n, share):
    """Rows of features 0 to 4 for toxic texts, 5 to 39 for all."""
    labels = (rng.random(n) < share).astype(int)
    rows = [
        np.sort(np.concatenate([rng.choice(np.arange(5, 40), 6, False), rng.choice(5, 2, False)[: 2 * y]]))
        for y in labels
    ]
    return rows, labels


def test_training_finds_toxic_texts_among_the_unlabelled():
    rng = np.random.default_rng(0)
    rows, labels = made(rng, 1500, 0.2)
    sure = [r for r, y in zip(*made(rng, 400, 1.0))]
    weights = train_one(sure, rows, 40, 0.2)
    found = margins(rows, weights) > 0
    assert (found == labels).mean() > 0.99
    # Unlabelled texts taken as clean, the toxic ones among them are not found as surely.
    as_clean = train_one(sure, rows, 40, 0.005)
    assert (margins(rows, weights)[labels == 1]).mean() > margins(rows, as_clean)[labels == 1].mean()


def test_the_risk_is_that_of_known_labels_in_the_mean():
    rng = np.random.default_rng(1)
    y = rng.random(200_000) < 0.3
    scores = rng.normal(size=len(y)) + 2 * y
    up, clean = nn_risk(scores[y], scores, 0.3)
    assert up == pytest.approx(0.3 * np.logaddexp(0, -scores[y]).mean())
    assert clean == pytest.approx(0.7 * np.logaddexp(0, scores[~y]).mean(), rel=0.01)


def test_a_negative_risk_is_stepped_back_from():
    """More features than texts: the risk of clean texts stays near or above zero."""
    rng = np.random.default_rng(2)
    sure = [rng.choice(400, 30, False) for _ in range(20)]
    rest = [rng.choice(400, 30, False) for _ in range(60)]
    weights = train_one(sure, rest, 400, 0.4, decay=0.0)
    assert nn_risk(margins(sure, weights), margins(rest, weights), 0.4)[1] > -0.05


def test_features():
    assert features_of({"idiots"}) == {"=idiots", "idio", "idiot"}
    shared = features_of({"idiots", "idiom", "idi"})
    assert shared == {"=idiots", "=idiom", "=idi", "idio", "+idio", "idiot"}
    long = "a" * 50 + "b"
    assert "=" + long in features_of({long}) and "=" + long[:50] not in features_of({long})
    sharing = toxicity.Model({"idio": 1.0, "+idio": 2.0, "=idi": 4.0}, -3.0)
    margins_of = [np.log(s / (1 - s)) for s in sharing.scores(["idiots", "idiots idiom", "idi", ""])]
    assert margins_of == pytest.approx([-2, 0, 1, -3])
    model = train([np.array([0])], [np.array([1]), np.array([], int)], ["=bad", "=good"], 0.1)
    texts = ["bad bad BAD!", "good", "", "neither"]
    scores = model.scores(texts)
    assert scores[0] > scores[2] == scores[3] >= scores[1]


def toxic_docs(n=400):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(words[(i * k) % 6] for k in (1, 5, 7))
        bad = i % 8 == 0
        rows.append((i, text + (" scumbag" if bad else "")))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_odd_rows_and_labels(spark, documents, saved):  # noqa: F811
    rows, labels = toxic_docs()
    rows += [(1000, None), (1001, ""), (None, "a scumbag"), (1002, "word " * 40_000 + "scumbag")]
    rows += [rows[0], rows[0]]
    labels += [(None, 0, 1), (1, None, None), (8, 1, 0), (99_999, 1, 1)]
    docs = documents(*rows).selectExpr("*", "1 AS SCORE", "'x' AS words")
    labelled = spark.createDataFrame(labels, LABELS)
    got = QUERIES["op4_toxicity"](spark, saved(documents=docs, labels=labelled)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].predicted == int(i % 8 == 0) for i in range(400))
    assert by_id[None].predicted == 1 and by_id[1002].predicted == 1
    assert by_id[1000].score == by_id[1001].score < 0.5
    model = toxicity.fit(docs, labelled)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {
        *(i for i in range(400) if i % 8), 1000, 1001
    }


def test_held_out_labels_teach_nothing(spark, documents):  # noqa: F811
    rows, labels = toxic_docs()
    docs = documents(*rows)
    turned = [(i, q, 1 - t if out_of_sample(i) else t) for i, q, t in labels]
    one, two = (
        toxicity.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned)
    )
    assert one == two


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_empty_tables(spark, documents, saved, empty):  # noqa: F811
    frames = {
        "documents": documents((1, "x"), (2, "y")),
        "labels": spark.createDataFrame([(1, 1, 1)], LABELS),
    }
    frames[empty] = frames[empty].where("false")
    got = QUERIES["op4_toxicity"](spark, saved(**frames)).collect()
    assert [r.score for r in got] == ([] if empty == "documents" else [0.0, 0.0])
