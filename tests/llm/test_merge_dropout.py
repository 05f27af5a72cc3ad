from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from adtally.llm import merge_dropout
from adtally.llm.merge_dropout import DROPOUT, SEED, Encoder, Pieces, encode_documents, model_path
from adtally.llm.queries import QUERIES
from conftest import SF_DIR
from llm_fixtures import documents, saved  # noqa: F401

MODEL = sentencepiece.SentencePieceProcessor(model_file=model_path())
PIECES = Pieces(model_path())


def ids(text, dropout=DROPOUT, seed=SEED):
    made = Encoder.__new__(Encoder)
    made.pieces, made.dropout, made.seed = PIECES, dropout, seed
    made.forget()
    return np.frombuffer(made(text), "<i4").tolist()


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=120))
@settings(max_examples=200, deadline=None)
def test_any_text_decodes_exactly(text):
    for seed in (0, 1):
        assert PIECES.decode(ids(text, 0.3, seed)) == text


@given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="▁\0"), max_size=120))
@settings(max_examples=200, deadline=None)
def test_without_dropout_as_the_library(text):
    assert ids(text, 0.0) == MODEL.encode(text)


@given(st.lists(st.sampled_from([*"abz Éé²1.,'#$%()-_<>", "the", "it's", "\n", "x.y"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_signs_without_dropout_as_the_library(text):
    assert ids(text, 0.0) == MODEL.encode(text)


def test_given_texts_without_dropout_as_the_library(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()
    encode = Encoder(model_path(), 0.0, 0)
    for (text,) in rows:
        assert np.frombuffer(encode(text), "<i4").tolist() == MODEL.encode(text)


def plain_dropout(word, dropout, seed):
    """The same agenda without a heap or links: the best live candidate, again and again."""
    import xxhash

    parts = [("▁" if c == " " else "\0▁" if c == "▁" else c, i, i + 1) for i, c in enumerate(word)]
    key, skipped = xxhash.xxh64_intdigest(word, seed), set()
    while True:
        live = []
        for x, y in zip(parts, parts[1:]):
            score = PIECES.score.get(x[0] + y[0])
            if score is not None and (x[1], y[1], y[2]) not in skipped:
                live.append((-score, x[1], y[1], y[2]))
        if not live:
            break
        _, a, b, c = min(live)
        h = (key ^ (a << 42 | b << 21 | c)) * 0x9E3779B97F4A7C15 & (2**64 - 1)
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & (2**64 - 1)
        if h ^ h >> 32 < int(dropout * 2**64):
            skipped.add((a, b, c))
            continue
        at = next(i for i, p in enumerate(parts) if p[1] == a)
        parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], a, c)]
    out = []
    for symbol, _, _ in parts:
        if symbol in PIECES.ids:
            out.append(PIECES.ids[symbol])
        else:
            out += [PIECES.byte_ids[b] for b in symbol.replace("\0▁", "▁").encode()]
    return out


@given(st.text(alphabet="thean ingorledé", min_size=1, max_size=14), st.integers(0, 50))
@settings(max_examples=300, deadline=None)
def test_dropout_as_the_plain_agenda(word, seed):
    assert PIECES.merge(word, 0.3, seed) == plain_dropout(word, 0.3, seed)


def test_seeds_vary_and_repeat():
    text = "the international understanding of segmentation " * 20
    made = [tuple(ids(text, 0.2, seed)) for seed in range(6)]
    assert len(set(made)) == 6 and made[0] == tuple(ids(text, 0.2, 0))
    assert all(len(m) >= len(MODEL.encode(text)) for m in made)
    assert ids(text, 1.0)[1:4] == [PIECES.ids[c] for c in "the"]


def by_word(made):
    """The pieces of each word; a word's first piece begins with its space."""
    ends = [i for i, piece in enumerate(made) if PIECES.bytes_[piece][:1] == b" "]
    return [tuple(made[a:b]) for a, b in zip(ends, [*ends[1:], None])]


def test_a_word_varies_within_one_run_and_the_run_repeats(spark, documents):  # noqa: F811
    text = "international " * 400 + "x " * 5 + "long " * 30 + "y" * 60
    df = documents((1, text), (2, text), (None, text), (3, "understanding"), (4, "understanding"))
    first, again = (
        {(r.doc_id, r.text): r.pieces for r in encode_documents(df, model_path(), 0.1, 3).collect()}
        for _ in range(2)
    )
    assert first == again
    assert len({tuple(first[d, text]) for d in (1, 2, None)}) == 3
    ways = by_word(first[1, text])[:400]
    assert {PIECES.decode(w) for w in ways} == {"international"} and len(set(ways)) > 5


def test_long_words_vary_by_place():
    word = "internationalunderstanding" * 3
    assert len(set(by_word(ids(f"{word} {word} {word}", 0.3)))) == 3


@given(st.text(alphabet="thean ingorledé", min_size=1, max_size=14), st.integers(0, 50))
@settings(max_examples=300, deadline=None)
def test_gaps_as_the_plain_agenda(word, seed):
    """The numbers of merges before each skipped candidate give the agenda's own result."""
    gaps, run = [], []

    def skipped(a, b, c, rng=np.random.default_rng(seed)):
        if rng.random() < 0.3:
            gaps.append(len(run))
            run.clear()
            return True
        run.append(a << 42 | b << 21 | c)
        return False

    want = PIECES._merge(word, skipped)
    assert PIECES.walk(word, tuple(gaps)) == (run, want)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_tables_give_what_hashing_each_candidate_gives(spark, monkeypatch, dropout):
    """Every occurrence merged on its own, long and short words alike."""
    monkeypatch.setattr(merge_dropout, "WORD_CACHE", 300)
    encode = Encoder(model_path(), dropout, 7)
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(20).collect()
    long = "internationalunderstanding" * 4
    for text in [*(r.text for r in rows), f"{long} a ▁b {long} \n c", "é" * 60]:
        import xxhash

        key = np.uint64(xxhash.xxh64_intdigest(text, 7))
        words = encode._words(text)
        steps = np.arange(1, len(words) + 1, dtype=np.uint64)
        keys = merge_dropout.mixed(key + merge_dropout.NEXT_WORD * steps).tolist()
        want = [i for w, k in zip(words, keys) for i in PIECES.merge_keyed(w, dropout, k)]
        assert np.frombuffer(encode(text), "<i4").tolist() == want


def test_candidates_are_skipped_at_the_rate():
    """Whole words are as frequent as no skip in all merges, first merges as one kept."""
    n, word = 20_000, "▁understanding"
    codes, whole = PIECES.walk(" understanding", ())
    merges = len(codes)
    assert len(whole) == 1 and merges == len(word) - 1
    made = ids(" ".join(["understanding"] * n), 0.1)
    assert made.count(whole[0]) / n >= 0.9**merges * 0.95
    rng = np.random.default_rng(1)
    plain = [PIECES._merge(" understanding", lambda *_: rng.random() < 0.1) for _ in range(n)]
    assert made.count(whole[0]) / n == pytest.approx(plain.count(whole) / n, abs=0.02)
    assert len(made) / n == pytest.approx(sum(map(len, plain)) / n, rel=0.02)


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op3_merge_dropout"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want, row = np.array(ids(text), "<i4"), got[doc_id]
        assert row.lossless and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.n_pieces, row.pieces_crc32) == (len(want), zlib.crc32(want.tobytes()))


def test_odd_rows_keep_their_columns(spark, documents):  # noqa: F811
    rows = [(1, None), (2, ""), (3, "x" * 30_000), (3, "x ▁\t\n  y "), (None, "\0 ▁▁ é")]
    df = documents(*rows).selectExpr("*", "doc_id AS PIECES", "'k' AS `a b`")
    out = encode_documents(df, model_path(), 0.1, 3)
    assert out.columns[:-1] == df.columns and out.columns[-1].lower() != "pieces"
    got = sorted((r.doc_id or 0, r.text or "", PIECES.decode(r[-1])) for r in out.collect())
    assert got == sorted((d or 0, t or "", t or "") for d, t in rows)


def test_empty_table(spark, documents, saved):  # noqa: F811
    folder = saved(documents=documents((1, "x")).where("false"))
    assert QUERIES["op3_merge_dropout"](spark, folder).collect() == []


def test_the_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(merge_dropout, "WORD_CACHE", 5)
    encode = Encoder(model_path(), 0.5, 0)
    for i in range(30):
        text = f"word{i} vowel{i} word"
        assert PIECES.decode(np.frombuffer(encode(text), "<i4").tolist()) == text
        assert len(encode.words.ids) < 10 and len(encode.ways.ids) < 30


ANY_WORD = st.one_of(
    st.text(alphabet="thean ingorledé", min_size=1, max_size=60),
    st.text(alphabet=st.characters(codec="utf-8"), max_size=12),
    st.text(alphabet=" ▁\0\x01a,.é😀\U0010ffff", max_size=8),
)


@given(st.lists(ANY_WORD, max_size=30), st.sampled_from([0.1, 0.5, 1.0]), st.integers(0, 2**32))
@settings(max_examples=300, deadline=None)
def test_words_merged_together_as_each_alone(words, dropout, seed):
    keys = merge_dropout.mixed(np.arange(len(words), dtype=np.uint64) + np.uint64(seed))
    made = [np.frombuffer(x, "<i4").tolist() for x in PIECES.merge_all(words, keys, dropout)]
    want = [PIECES.merge_keyed(w, dropout, k) if w else [] for w, k in zip(words, keys.tolist())]
    assert made == want


def test_short_words_are_never_merged_alone(spark, monkeypatch):
    """Texts cut together, in blocks of any length, are those cut one by one."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(60).collect()
    texts = [*(r.text for r in rows), None, "", "x" * 100, "é ▁ \n"]
    one = Encoder(model_path(), DROPOUT, SEED)
    want = [one(t, i) for i, t in enumerate(texts)]
    alone = Pieces.merge_keyed

    def long_only(self, word, dropout, key):
        assert len(word) > merge_dropout.SHORT
        return alone(self, word, dropout, key)

    monkeypatch.setattr(Pieces, "merge_keyed", long_only)
    for chars in (1, 5_000, 10**9):
        monkeypatch.setattr(merge_dropout, "BLOCK_CHARS", chars)
        encode = Encoder(model_path(), DROPOUT, SEED)
        assert encode.many(texts, list(range(len(texts)))) == want
