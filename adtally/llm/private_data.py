"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds to them.

The patterns give the base spans. A conditional random field then reads the words around
every digit and every ``@``, in whole texts: each word is described by its shape and those
of its neighbours, a chain of labels is found by Viterbi, and what it marks is added where no
base span lies, if it has the digits that its kind needs. Words further from any digit or
``@`` than ``CONTEXT`` words cannot be personal data of these kinds; chains end there.

The field is trained from a small labelled table: words of at most ``TRAIN_DOCS`` documents
(those with the smallest hash of their id), labelled by the patterns, and the same words in
spellings that the patterns miss (a telephone number without its plus sign, letters outside
ASCII in an address), so that shapes and not exact patterns are learnt.

Rows: a null or empty text has no spans. A text without labels in the whole table leaves the
field untrained, and base spans alone come out. Repeated rows all stay; an empty table gives
no rows. Only doc_id and text are read; ``redact`` keeps all other columns but n_chars, which
it brings up to date.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.common import importable, small_batches, table

# --- Fixed values: the kinds in their order, and their patterns ----------------------------
KINDS = ("email", "ip", "card", "phone")
#: The email pattern behind its ``@``; what stands before is found by walking back from it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Possessive, and begun at a run's first digit only, so that long runs take linear time.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
CONTEXT = 2
TRAIN_DOCS, TRAIN_CHAINS = 2_000, 6_000
#: Words of a training chain; longer ones are several chains.
TRAIN_WORDS = 400
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BARRED = -1e9


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' matches by start and kind; those that fail their check are dropped."""
    first = TRIGGER.search(text)
    if not first:
        return []
    out, seen = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            lead = text[seen : m.start()]
            start = seen + len(lead.rstrip(LOCAL))
            if start < m.start():
                out.append(Span(start, 0, m.end()))
                seen = m.end()
    at = first.start()
    for m in IP.finditer(text, at):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(Span(m.start(), 1, m.end()))
    for m in CARD.finditer(text, at):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


def words_before(text: str, low: int, high: int, count: int) -> list[tuple[int, int]]:
    """The last ``count`` words (start, end) of ``text[low:high]``, in order."""
    size = 64
    while True:
        start = max(low, high - size)
        words = [(w.start(), w.end()) for w in WORD.finditer(text, start, high)]
        if start == low or len(words) > count:  # the first one may be cut
            return words[-count:]
        size *= 4


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around digits and ``@``, in order, without overlap."""
    out: list[list[tuple[int, int]]] = []
    done = 0  # the end of the last word taken
    m = TRIGGER.search(text)
    while m:
        at = m.start()
        before = words_before(text, done, at, CONTEXT + 1)
        begin = at
        if before and before[-1][1] == at:
            begin = before.pop()[0]
        end = WORD.match(text, begin).end()
        lead = before[-CONTEXT:]
        if out and lead and lead[0][0] - done <= 1 or out and not lead and begin - done <= 1:
            run = out[-1]
        else:
            run = []
            out.append(run)
        run += [*lead, (begin, end)]
        done = end
        # Words that follow, as far as no other one has a digit.
        for _ in range(CONTEXT):
            w = WORD.search(text, done)
            if not w or TRIGGER.search(text, w.start(), w.end()):
                break
            run.append((w.start(), w.end()))
            done = w.end()
        m = TRIGGER.search(text, done)
    return out


SHAPES = (
    (re.compile(r"[0-9]+"), lambda m: "9" * min(len(m[0]), 5)),
    (re.compile(r"[A-Z]+"), lambda m: "X"),
    (re.compile(r"[^\W\d_X]+"), lambda m: "x"),
)


def shape(word: str) -> str:
    """Letters as X or x, runs of up to five digits as nines, signs as they are."""
    for pattern, put in SHAPES:
        word = pattern.sub(put, word)
    return word


def word_features(word: str) -> list[str]:
    digits = "".join(c for c in word if c in "0123456789")
    own = shape(word)
    return [
        "s:" + own,
        "c:" + re.sub("9+", "9", own).strip(".,;:!?"),
        f"d:{min(len(digits), 20)}",
        "first:" + own[:1],
        f"at:{'@' in word}{min(word.count('.'), 9)}",
        f"luhn:{14 <= len(digits) <= 19 and luhn(digits)}",
    ]


def chain_features(words: list[str]) -> list[list[str]]:
    """Features of each word: its own, and the shapes of its neighbours."""
    own = [word_features(w) for w in words]
    edge = ["s:|", "c:|"]
    out = []
    for i, features in enumerate(own):
        before, after = own[i - 1] if i else edge, own[i + 1] if i + 1 < len(own) else edge
        out.append(
            [*features, "bias", "p" + before[1], "n" + after[1], f"p{before[1]} {features[1]}"]
        )
    return out


def chain_labels(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Label of each word by the span that covers its middle; the earliest one wins."""
    out = [0] * len(words)
    for span in reversed(spans):
        inside = [i for i, (a, b) in enumerate(words) if a < span.end and b > span.start]
        for k, i in enumerate(inside):
            out[i] = 1 + 2 * span.kind + (k > 0)
    return out


class Field(NamedTuple):
    """A trained field: rows of weights by feature, and scores of neighbouring labels."""

    rows: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        known = [[self.rows[f] for f in fs if f in self.rows] for fs in features]
        return np.array([self.weights[k].sum(axis=0) for k in known])


def allowed() -> np.ndarray:
    """0 where a label may follow another one; an inside label only follows its own kind."""
    n = len(LABELS)
    bar = np.zeros((n, n))
    for b in range(2, n, 2):
        bar[:, b] = BARRED
        bar[[b - 1, b], b] = 0
    return bar


START_BAR = np.array([BARRED if label[0] == "I" else 0.0 for label in LABELS])


def padded(chains_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains_])
    out = np.zeros((len(chains_), lengths.max(), chains_[0].shape[1]))
    for i, c in enumerate(chains_):
        out[i, : len(c)] = c
    return out, lengths


def viterbi(emissions: list[np.ndarray], moves: np.ndarray) -> list[list[int]]:
    """The best labels of each chain, for a batch of chains at once."""
    if not emissions:
        return []
    scores, lengths = padded(emissions)
    n, longest, labels = scores.shape
    best = scores[:, 0] + START_BAR
    back = np.zeros((n, longest, labels), np.int8)
    for t in range(1, longest):
        paths = best[:, :, None] + moves
        back[:, t] = paths.argmax(axis=1)
        step = paths.max(axis=1) + scores[:, t]
        best = np.where((t < lengths)[:, None], step, best)
    out = []
    for i, length in enumerate(lengths):
        label = int(best[i].argmax())
        path = [label]
        for t in range(length - 1, 0, -1):
            label = int(back[i, t, label])
            path.append(label)
        out.append(path[::-1])
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    features: list[list[list[str]]],
    labels: list[list[int]],
    rounds: int = 60,
    rate: float = 0.15,
    decay: float = 1e-3,
) -> Field | None:
    """Maximum likelihood of the labels, by Adam on the whole table; no randomness."""
    if not features:
        return None
    rows: dict[str, int] = {}
    for chain in features:
        for fs in chain:
            for f in fs:
                rows.setdefault(f, len(rows))
    n, lab = len(features), len(LABELS)
    lengths = np.array([len(c) for c in features])
    longest, width = lengths.max(), len(features[0][0])
    at = np.full((n, longest, width), len(rows))  # the last row stays zero
    gold = np.zeros((n, longest), int)
    for i, (chain, own) in enumerate(zip(features, labels)):
        at[i, : len(chain)] = [[rows[f] for f in fs] for fs in chain]
        gold[i, : len(chain)] = own
    mask = np.arange(longest) < lengths[:, None]
    weights, moves = np.zeros((len(rows) + 1, lab)), np.zeros((lab, lab))
    bar = allowed()
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    hot = np.eye(lab)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    gold_moves = np.einsum("nti,ntj->ij", hot[:, :-1] * pairs[..., None], hot[:, 1:])
    for step in range(1, rounds + 1):
        scores, trans = weights[at].sum(axis=2), moves + bar
        ahead = np.zeros((n, longest, lab))
        ahead[:, 0] = scores[:, 0] + START_BAR
        for t in range(1, longest):
            nxt = _logsumexp(ahead[:, t - 1, :, None] + trans, 1) + scores[:, t]
            ahead[:, t] = np.where(mask[:, t, None], nxt, ahead[:, t - 1])
        behind = np.zeros((n, longest, lab))
        for t in range(longest - 2, -1, -1):
            nxt = _logsumexp(trans + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
        total = _logsumexp(ahead[:, -1], 1)[:, None, None]
        share = np.exp(ahead + behind - total) * mask[..., None]
        gap = (share - hot) / n
        grad_moves = -gold_moves / n
        for t in range(1, longest):
            joint = ahead[:, t - 1, :, None] + trans + (scores[:, t] + behind[:, t])[:, None, :]
            grad_moves += (np.exp(joint - total) * mask[:, t, None, None]).sum(axis=0) / n
        grad = np.zeros_like(weights)
        np.add.at(grad, at.reshape(-1, width), np.repeat(gap.reshape(-1, 1, lab), width, axis=1))
        for value, slope, k in ((weights, grad, 0), (moves, grad_moves, 2)):
            slope = slope + decay * value
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * slope**2
            value -= rate * (moments[k] / (1 - 0.9**step)) / (
                np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8
            )
        weights[-1] = 0
    return Field(rows, weights[:-1].astype(np.float32), (moves + bar).astype(np.float64))


DIGITS = {1: (4, 12), 2: (14, 19), 3: (10, 15)}


def marked(text: str, words: list[tuple[int, int]], path: list[int]) -> list[Span]:
    """The spans that a chain's labels mark, trimmed, if they hold what their kind needs."""
    out, i = [], 0
    while i < len(path):
        if path[i] % 2 == 0:  # outside, or inside without a beginning
            i += 1
            continue
        kind, j = (path[i] - 1) // 2, i + 1
        while j < len(path) and path[j] == path[i] + 1:
            j += 1
        start, end = words[i][0], words[j - 1][1]
        own = text[start:end]
        end -= len(own) - len(own.rstrip(".,;:!?)]}>\"'|"))
        own = text[start:end]
        start += len(own) - len(own.lstrip("[{<\"'|" if kind == 3 else "([{<\"'|"))
        own = text[start:end]
        digits = sum(map(str.isdigit, own))
        if kind == 0:
            good = own.count("@") == 1 and "." in own.split("@")[1].strip(".") and own[0] != "@"
        else:
            good = DIGITS[kind][0] <= digits <= DIGITS[kind][1]
            good = good and all(c.isdigit() or c in " .-()+" for c in own)
        if kind == 1:
            good = good and bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", own))
            good = good and all(int(p) < 256 for p in own.split("."))
        if kind == 2:
            good = good and luhn("".join(c for c in own if c in "0123456789"))
        if good:
            out.append(Span(start, kind, end))
        i = j
    return out


def with_added(
    texts: list[str], field: Field | None
) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and the field's, which overlap none of them."""
    base = [base_spans(t) for t in texts]
    if field is None:
        return [(b, []) for b in base]
    runs = [(i, run) for i, t in enumerate(texts) for run in chains(t)]
    added: list[list[Span]] = [[] for _ in texts]
    # Chains of like length together, so that little of a batch is padding.
    runs.sort(key=lambda r: len(r[1]))
    low = 0
    while low < len(runs):
        size = max(1, 20_000 // len(runs[min(low + 200, len(runs) - 1)][1]))
        part, low = runs[low : low + size], low + size
        emissions = [
            field.emissions(chain_features([texts[i][a:b] for a, b in run])) for i, run in part
        ]
        for (i, run), path in zip(part, viterbi(emissions, field.moves)):
            if any(path):
                added[i] += marked(texts[i], run, path)
    out = []
    for own, more in zip(base, added):
        kept = [s for s in more if all(s.end <= b.start or s.start >= b.end for b in own)]
        out.append((own, sorted(set(kept))))
    return out


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


# Spellings of base spans that the patterns miss, for the labelled table.
def respelled(kind: int, own: str) -> str | None:
    if kind == 3 and re.match(r"\+[0-9]{1,3}[ -]", own):
        return re.sub(r"^\+[0-9]{1,3}[ -]", "", own)
    if kind == 0:
        return re.sub("[aeiou]", lambda m: "áéíóú"["aeiou".index(m[0])], own[:2]) + "é" + own[2:]
    return None


CHAIN = "words ARRAY<STRING>, labels ARRAY<INT>"


def labelled_chains(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """The labelled table: words and labels around the digits of at most ``most`` documents."""
    importable(docs.sparkSession)
    chosen = (
        docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(
        F.broadcast(chosen), "doc_id", "left_semi"
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for run in chains(text):
                    own = chain_labels(run, spans)
                    for k in range(0, len(run), TRAIN_WORDS):
                        words.append([text[a:b] for a, b in run[k : k + TRAIN_WORDS]])
                        labels.append(own[k : k + TRAIN_WORDS])
                for span in spans:
                    other = respelled(span.kind, text[span.start : span.end])
                    if other:
                        before = words_before(text, 0, span.start, CONTEXT)
                        lead = [text[a:b] for a, b in before]
                        tail = [w[0] for w in islice(WORD.finditer(text, span.end), CONTEXT)]
                        calm = [w for w in lead + tail if not TRIGGER.search(w)]
                        k = sum(w in calm for w in lead)
                        parts = other.split()
                        marks = [1 + 2 * span.kind + (i > 0) for i in range(len(parts))]
                        words.append([*calm[:k], *parts, *calm[k:]])
                        labels.append([0] * k + marks + [0] * (len(calm) - k))
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))],
                    names=["words", "labels"],
                )

    return rows.select("text").mapInArrow(label, CHAIN)


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Field | None:
    """A field trained on the labelled table, of at most ``TRAIN_CHAINS`` chains."""
    key = F.xxhash64(F.array_join("words", " "))
    rows = labelled_chains(docs, most).orderBy(key, "words").limit(TRAIN_CHAINS).collect()
    rows = sorted((tuple(r.words), tuple(r.labels)) for r in rows)
    return train([chain_features(list(w)) for w, _ in rows], [list(y) for _, y in rows])


FOUND = (
    "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, "
    "base_sha256 STRING, spans STRING, n_added BIGINT"
)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """Base counts and digest, and all spans, of every document; a map without a shuffle."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, 1):
            out = []
            for key, (base, more) in zip(part.column(0).to_pylist(), with_added(texts, field)):
                counts = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(as_text(base).encode()).hexdigest()
                out.append((key, *counts, digest, as_text(sorted(base + more)), len(more)))
            if out:
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with a tag in place of each span; where spans overlap, the first one rules."""
    out, at = [], 0
    for span in sorted(spans):
        if span.start >= at:
            out += [text[at : span.start], f"<{KINDS[span.kind].upper()}>"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with all spans replaced by tags, and n_chars counted anew where present."""
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    names = [c.lower() for c in docs.columns]
    text_at = names.index("text")
    count_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, text_at):
            made = [redacted(t, [*b, *m]) for t, (b, m) in zip(texts, with_added(texts, field))]
            columns, old = list(part.columns), part.column(text_at)
            null = old.is_null().to_pylist()
            columns[text_at] = pa.array(
                [None if n else t for n, t in zip(null, made)], old.type
            )
            if count_at is not None:
                kept = part.column(count_at)
                values = [
                    k if n or k is None else len(t)
                    for n, k, t in zip(null, kept.to_pylist(), made)
                ]
                columns[count_at] = pa.array(values, kept.type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
