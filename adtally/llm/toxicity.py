"""Toxicity by positive-unlabelled learning with a non-negative risk.

Classifiers learn from texts confirmed as toxic and from texts of which nothing is said. With
the share of toxic texts (the class prior) known, the risk of a classifier is estimated from
these two alone: the unlabelled texts' risk as negatives, less the share of it that the toxic
ones among them cause, and never below zero (where the estimate falls below zero, the step
goes the other way). The classifiers are logistic and linear over the presence of words, of
word beginnings, and of beginnings that several of a text's words share; each is trained on a
share of the unlabelled texts, and their mean decides. How far a feature's shares in the two
samples are apart sets its decay: with few toxic texts no feature is certain, and those that
chance may have made stay small, but no text is left without any.

What passes through the driver is bounded: at most ``MOST_TOXIC`` toxic and
``MOST_UNLABELLED`` unlabelled texts (those with the smallest hash of their id), as indices
of at most ``MOST_FEATURES`` features; these are chosen by their counts in those texts.
Scoring is a map over all rows. The class prior is the share of toxic rows among the labels.

Rows: a null text is an empty one, and has the score of a text without any known feature.
Labels of a held-out doc_id (``crc32(doc_id) mod 5 = 0``), null labels and null ids teach
nothing; a doc_id with several labels is toxic if any of them says so. Without toxic texts
every score is 0. Repeated rows all stay; an empty table gives no rows. Scores are made of
the text alone: doc_id, lang, source and labels are no input.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.common import importable, small_batches, stored, table

MOST_TOXIC, MOST_UNLABELLED = 6_000, 12_000
MOST_FEATURES = 6_000
#: Texts of the sample that a feature must occur in: one alone tells nothing of others.
LEAST_TEXTS = 2
#: The decay of the feature with the largest gain, and the power to which that of another one
#: grows with the ratio of the gains.
DECAY, GRADE = 2e-4, 1.5
MODELS = 5
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, marked as whole, their beginnings, and marked, those that words share."""
    out = {"=" + w for w in words}
    for w in words:
        for start in beginnings(w):
            out.add("+" + start if start in out else start)
    return out


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) > n]


class Model(NamedTuple):
    """Weights by word and by beginning, and the score without any."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[float]:
        """Probabilities; a word's share of the margin is looked up once per batch."""
        share = _Shares(self.weights)
        out = []
        for text in texts:
            heard: set[str] = set()
            for word in words_of(text):
                for feature in share[word]:
                    heard.add("+" + feature if feature in heard else feature)
            found = (self.weights.get(feature, 0.0) for feature in heard)
            margin = self.bias + math.fsum(found)  # in any order the same
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, margin)))))
        return out


class _Shares(dict):
    """The features of a word that have a weight, shared or not; found when it is first met."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        own = ["=" + word, *beginnings(word)]
        found = tuple(f for f in own if f in self.weights or "+" + f in self.weights)
        if len(self) < 400_000:
            self[word] = found
        return found


def margins(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The sum of each row's weights, and the bias, which comes last."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    lengths = np.array([len(r) for r in rows], np.int64)
    sums = np.concatenate([[0.0], np.cumsum(weights[flat])])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths] + weights[-1]


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def nn_risk(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of toxic texts, and of the others (before it is held at 0).

    Both take margins, under logistic loss.
    """
    as_toxic = prior * softplus(-toxic).mean()
    as_clean = softplus(unlabelled).mean() - prior * softplus(toxic).mean()
    return as_toxic, as_clean


def train_one(
    toxic: list[np.ndarray],
    unlabelled: list[np.ndarray],
    n_features: int,
    prior: float,
    rounds: int = 300,
    rate: float = 0.05,
    decay: float | np.ndarray = DECAY,
) -> np.ndarray:
    """Weights, the bias last, by Adam on the non-negative risk over all rows.

    ``decay`` is one for all features, or one for each.
    """
    weights = np.zeros(n_features + 1)
    weights[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    flats = [np.concatenate(r) if r else np.zeros(0, np.int64) for r in (toxic, unlabelled)]
    lengths = [np.array([len(x) for x in r]) for r in (toxic, unlabelled)]

    def gradient(k: int, per_row: np.ndarray) -> np.ndarray:
        out = np.bincount(
            flats[k], weights=np.repeat(per_row, lengths[k]), minlength=n_features + 1
        )
        out = out.astype(np.float64)
        out[-1] = per_row.sum()
        return out

    for step in range(1, rounds + 1):
        m_toxic, m_rest = margins(toxic, weights), margins(unlabelled, weights)
        as_clean = nn_risk(m_toxic, m_rest, prior)[1]
        up_toxic = -prior * sigmoid(-m_toxic) / len(m_toxic)
        down_toxic = -prior * sigmoid(m_toxic) / len(m_toxic)
        down_rest = sigmoid(m_rest) / len(m_rest)
        if as_clean >= 0:
            slope = gradient(0, up_toxic + down_toxic) + gradient(1, down_rest)
        else:  # the estimate of a risk below zero: step back out of the overfit
            slope = -gradient(0, down_toxic) - gradient(1, down_rest)
        slope[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def train(
    toxic: list[np.ndarray],
    unlabelled: list[np.ndarray],
    names: list[str],
    prior: float,
    gains: list[float] | None = None,
) -> Model:
    """The mean of ``MODELS`` classifiers, each without another share of the unlabelled."""
    decay: float | np.ndarray = DECAY
    if gains:
        decay = DECAY * (max(gains) / np.maximum(gains, 1e-3)) ** GRADE
    prior = min(0.5, max(0.005, prior))
    total = np.zeros(len(names) + 1)
    for k in range(MODELS):
        rest = [r for i, r in enumerate(unlabelled) if i % MODELS != k] or unlabelled
        total += train_one(toxic, rest, len(names), prior, decay=decay)
    total /= MODELS
    kept = {n: float(w) for n, w in zip(names, total) if abs(w) > 1e-3}
    return Model(kept, float(total[-1]))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _smallest(ids: DataFrame, most: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float] | None:
    """``(toxic, words)`` of the bounded sample, and the class prior."""
    importable(docs.sparkSession)
    said = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rows, bad = said.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not bad:
        return None
    toxic = said.where("toxic = 1").select("doc_id")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").where(~held_out()).distinct()
    chosen = (
        _smallest(toxic.join(ids, "doc_id", "left_semi"), MOST_TOXIC)
        .withColumn("part", F.lit(1))
        .unionAll(_smallest(ids, MOST_UNLABELLED).withColumn("part", F.lit(0)))
    )
    chosen = stored(chosen, "chosen")  # at most some thousands of ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["part", "words"]
            )

    made = texts.select("part", "text").mapInArrow(cut, "part INT, words ARRAY<STRING>")
    return stored(made, "words"), bad / rows


def chosen_features(rows: DataFrame, most: int = MOST_FEATURES) -> list[tuple[str, float]]:
    """Features that tell toxic texts most from the others, and their gains.

    The gain is twice the logarithm of how much likelier the counts are with a share for each
    sample than with one for both.
    """
    importable(rows.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for part, words in zip(*(c.to_pylist() for c in batch.columns)):
                for f in features_of(set(words)):
                    counts.setdefault(f, [0, 0])[part] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                names=["feature", "rest", "toxic"],
            )

    sizes = rows.groupBy().pivot("part", [0, 1]).count().first()
    n_rest, n_toxic = sizes["0"] or 0, sizes["1"] or 0
    counts = (
        rows.mapInArrow(spread, "feature STRING, rest BIGINT, toxic BIGINT")
        .groupBy("feature")
        .agg(F.sum("rest").alias("rest"), F.sum("toxic").alias("toxic"))
        .where(F.col("rest") + F.col("toxic") >= LEAST_TEXTS)
    )

    def likelihood(with_it: Column, n: int) -> Column:
        def part(count: Column) -> Column:
            return F.when(count > 0, count * F.log(count / F.lit(float(n)))).otherwise(0.0)

        return part(with_it) + part(F.lit(n) - with_it)

    apart = likelihood(F.col("rest"), n_rest) + likelihood(F.col("toxic"), n_toxic)
    gain = 2 * (apart - likelihood(F.col("rest") + F.col("toxic"), n_rest + n_toxic))
    best = counts.select("feature", F.round(gain, 6).alias("gain"))
    found = best.orderBy(F.desc("gain"), "feature").limit(most).collect()
    return [(r.feature, r.gain) for r in found]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    found = sample(docs, labels)
    if found is None:
        return None
    rows, prior = found
    chosen = chosen_features(rows)
    names, gains = [f for f, _ in chosen], [gain for _, gain in chosen]
    place = {f: i for i, f in enumerate(names)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, lists = (c.to_pylist() for c in batch.columns)
            made = [sorted(place[f] for f in features_of(set(w)) if f in place) for w in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(made, pa.list_(pa.int32()))],
                names=["part", "at"],
            )

    parts: dict[int, list] = {0: [], 1: []}
    for part, at in rows.mapInArrow(index, "part INT, at ARRAY<INT>").toLocalIterator():
        parts[part].append(tuple(at))
    toxic, rest = ([np.array(r, np.int64) for r in sorted(parts[k])] for k in (1, 0))
    if not toxic or not rest:
        return None
    return train(toxic, rest, names, prior, gains)


SCORES = "doc_id BIGINT, held_out BOOLEAN, score DOUBLE, predicted INT"


def score_texts(texts: list[str | None], model: Model | None) -> list[float]:
    return model.scores([t or "" for t in texts]) if model else [0.0] * len(texts)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row's score; a map without a shuffle."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            scores = score_texts(texts, model)
            out = [k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(out, pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, model: Model | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``limit``, with all their columns."""
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    text_at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(batch.column(text_at).to_pylist(), model)
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
