from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adtally.llm import private_data as pd_
from adtally.llm.private_data import (
    KINDS, LABELS, Field, Span, allowed, as_text, base_spans, chain_features, chains, luhn,
    redacted, train, viterbi, with_added,
)
from adtally.llm.queries import QUERIES
from conftest import SF_DIR
from llm_fixtures import documents, saved  # noqa: F401

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    """The patterns as stated."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and luhn(digits),
                10 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append(Span(m.start(), kind, m.end()))
    return sorted(out)


PARTS = [
    "a@b.co", "x.y+z@m-1.example.com", "@", ".", "+", "1", "42", "255", "256", "10.0.0.1", "é",
    " ", "-", "(", ")", "4111 1111 1111 1111", "4041894974608795", "+1 (988) 555-2485", "\n",
    "+49 30 1234567", "00", "a", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "%",
]


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text",
    ["9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a.b@" * 40_000, "+1" + " " * 200_000,
     "1 " * 100_000, "@a.b" * 40_000, "x" * 200_000 + "1" + "y" * 200_000],
)
def test_long_runs_take_linear_time(text):
    base_spans(text)
    covered = chains(text)
    assert covered or not re.search("[0-9@]", text)


@given(st.lists(st.sampled_from([*PARTS, "word ", "two words\n"]), max_size=16).map("".join))
@settings(max_examples=300, deadline=None)
def test_chains_hold_every_digit_once(text):
    words = [w for run in chains(text) for w in run]
    assert words == sorted(words) and all(a[1] <= b[0] for a, b in zip(words, words[1:]))
    every = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    assert set(words) <= set(every)
    assert {w for w in every if re.search("[0-9@]", text[slice(*w)])} <= set(words)


def path_score(path, emissions, moves):
    score = sum(emissions[t][y] for t, y in enumerate(path)) + pd_.START_BAR[path[0]]
    return score + sum(moves[a][b] for a, b in zip(path, path[1:]))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(len(LABELS),) * 2) + allowed()
    batch = [rng.normal(size=(n, len(LABELS))) * 2 for n in (1, 3, 4, 2)]
    for emissions, path in zip(batch, viterbi(batch, moves)):
        every = itertools.product(range(len(LABELS)), repeat=len(emissions))
        best = max(every, key=lambda p: path_score(p, emissions, moves))
        assert tuple(path) == best


def test_training_follows_the_gradient_of_the_likelihood():
    """Labels that depend on a neighbour are learnt, which words alone cannot tell apart."""
    words = [["Tel:", "123", "now"], ["page", "123", "now"]] * 20
    labels = [[0, 7, 0], [0, 0, 0]] * 20
    field = train([chain_features(w) for w in words], labels)
    made = viterbi([field.emissions(chain_features(w)) for w in words[:2]], field.moves)
    assert made == labels[:2]


def test_context_is_found_at_any_distance():
    long = "y" * 300
    for text in (f"{long} a{' ' * 500}12 b", f"{'z ' * 90}{long} a {long}12 b", f"{long}@x"):
        (run,) = chains(text)
        words = text.split()
        at = next(i for i, w in enumerate(words) if "12" in w or "@" in w)
        assert [text[a:b] for a, b in run] == words[max(0, at - 2) : at + 3]


def test_long_words_are_described_whole():
    word = "a" * 100 + "7" * 15
    assert pd_.shape(word) == "x99999"
    assert "d:15" in pd_.word_features(word)
    assert pd_.word_features("." * 100 + "@")[4] == "at:True9"


def test_an_inside_label_never_starts_a_span():
    moves = allowed()
    emissions = np.zeros((2, len(LABELS)))
    emissions[:, 2] = 5
    (path,) = viterbi([emissions], moves)
    assert path in ([1, 2],)


@pytest.fixture(scope="module")
def field(spark):
    return pd_.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_the_field_finds_what_the_patterns_find(spark, field):
    """Held-out documents: spans of the field alone against those of the patterns."""
    rows = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/documents.parquet")
    texts = [r.text for r in rows.where("doc_id >= 500").select("text").collect()]
    base = {(i, s) for i, t in enumerate(texts) for s in base_spans(t)}
    found = set()
    for i, t in enumerate(texts):
        runs = chains(t)
        made = [field.emissions(chain_features([t[a:b] for a, b in run])) for run in runs]
        for run, path in zip(runs, viterbi(made, field.moves)):
            found |= {(i, s) for s in pd_.marked(t, run, path)}
    assert len(base) > 30
    assert len(found & base) / len(base) > 0.9
    assert len(found & base) / len(found) > 0.9


def test_the_field_adds_spellings_that_the_patterns_miss(field):
    text = "the thing wrote to hélér.42@mail8.example.com and the other one"
    ((base, more),) = with_added([text], field)
    assert base == [] or base[0].kind == 0
    joined = " ".join(text[s.start : s.end] for s in base + more)
    assert "@mail8.example.com" in joined


def test_clean_numbers_stay(field):
    texts = ["Licensed under CC BY-NC 4.0.\nthe next", "version 3. of 2019-05-04 in 100 000 parts"]
    assert with_added(texts, field) == [([], []), ([], [])]


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op2_private_data"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base, row = plain_spans(text), got[doc_id]
        assert row.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        counts = [sum(s.kind == k for s in base) for k in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        every = row.spans.split(",") if row.spans else []
        assert set(filter(None, as_text(base).split(","))) <= set(every)
        assert len(every) == len(base) + row.n_added
        keys = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in every]
        assert keys == sorted(keys)


def test_odd_rows(spark, documents, saved):  # noqa: F811
    long = "word " * 40_000 + "a@b.co"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "+1 (988) 555-2485 x")]
    df = documents(*rows).selectExpr("*", "'q' AS SPANS", "1 AS base")
    got = QUERIES["op2_private_data"](spark, saved(documents=df)).collect()
    spans = sorted((r.doc_id or 0, r.spans) for r in got)
    assert spans == [(0, "phone:0:17"), (1, ""), (2, ""), *[(3, "email:200000:200006")] * 2]
    out = pd_.redact(df, None)
    assert out.columns == df.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[None] == ("<PHONE> x", 9) and texts[1] == (None, 0)
    assert texts[3] == ("word " * 40_000 + "<EMAIL>", 200_007)


def test_redaction_of_overlapping_spans():
    assert redacted("ab12cd34", [Span(2, 1, 4), Span(3, 2, 6)]) == "ab<IP>34"


def test_empty_table_and_no_labels(spark, documents, saved):  # noqa: F811
    folder = saved(documents=documents((1, "x")).where("false"))
    assert QUERIES["op2_private_data"](spark, folder).collect() == []
    assert pd_.fit(documents((1, "no digits at all"))) is None
    assert isinstance(pd_.fit(documents((1, "only 1 digit"))), Field)
