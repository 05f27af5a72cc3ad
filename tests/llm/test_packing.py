from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import documents, saved  # noqa: F401
from tokenizers import Tokenizer

from adtally.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "\ta  b　 c ",
    "it's 3.5, isn't it?! (x)...", "foo.bar,baz;'s 's' !'s", "<|endoftext|>", "a<|endoftext|> b.",
    "éà ÀÉ ª º Ā ĀB", "\x1c a \x1c", "a\0b, c", "\0", "日本語 テキスト。 x", "é e", "9 1,000.5%",
]


def plain(texts):
    made = TOKENIZER.encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in made]


def test_words_give_the_ids_of_whole_texts():
    encode = packing.WordEncoder(PATH)
    assert list(encode(pa.array(ODD))) == plain(ODD)
    assert list(encode(pa.array(["x", *ODD, "y"]).slice(3, 9))) == plain(ODD[2:11])
    assert list(encode(pa.array([], pa.string()))) == []
    draw = random.Random(5)
    signs = "ab Z9.,;:!?'\"-<|>\n\t éÀĀ ́日\0 "
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(5_000)]
    assert list(encode(pa.array(texts))) == plain(texts)


def test_portions_hold_all_rows(monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 10)
    texts = ["", "a" * 30, "b", "", "c" * 9, "d" * 10, "e", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["k", "t"])
    parts = list(packing._portions(batch))
    assert [k for keys, _ in parts for k in keys.to_pylist()] == list(range(8))
    assert [t for _, part in parts for t in part.to_pylist()] == texts
    assert len(parts) > 3 and list(packing._portions(batch.slice(0, 0))) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 20_000))
def test_cuts_fill_their_class(length):
    sizes = packing.cuts(length)
    assert sum(sizes) == length
    for size in sizes:
        number = packing.CAPACITY // size
        assert number >= packing.SMALL or number * size >= packing.CAPACITY - packing.SLACK


def checked(rows, docs, capacity=packing.CAPACITY, end=1):
    """Every id in one piece, sequences without gaps, and little padding; returns its tokens."""
    ids = {d: np.frombuffer(x, "<u4").tolist() + [end] for d, x in docs.items()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == part
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length, r["class"]))
    assert set(pieces) == set(ids)
    for doc, spans in pieces.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        number = parts[0][2]
        if 0 < number < packing.SMALL:
            assert len(parts) == number  # the class's fixed count
        if at & (at - 1):
            assert capacity - at <= packing.SLACK
            padding += capacity - at
    return padding


def test_pieces_of_many_workers(spark, documents):
    draw = random.Random(3)
    words = ["alpha", "beta,", "gamma.", "delta", "été", "\n"]
    texts = {
        k: " ".join(draw.choices(words, k=draw.choice([0, 3, 40, 700, 1_500, 9_000])))
        for k in range(300)
    }
    docs = documents(*texts.items()).repartition(23)
    rows = packing.pack(docs, PATH, 1, fan_in=4).collect()
    ids = dict(zip(texts, plain(list(texts.values()))))
    assert checked(rows, ids) < 0.004 * sum(len(x) // 4 + 1 for x in ids.values())


def test_odd_rows(spark, documents):
    docs = documents((None, None), (1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "x " * 30_000))
    clash = docs.selectExpr("*", "text AS ids", "doc_id AS worker", "1 AS sequence_id", "2 AS class")
    rows = packing.pack(clash, PATH, 1).collect()
    texts = {None: "", 1: "", 2: "", 3: "a b", 4: "a b", 5: "x " * 30_000}
    assert checked(rows, dict(zip(texts, plain(list(texts.values())))))  == 0
    assert packing.pack(docs.limit(0), PATH, 1).collect() == []


def test_repeated_rows_are_documents_of_their_own(spark, documents):
    rows = packing.pack(documents((7, "a b"), (7, "a b"), (7, "c")), PATH, 1).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows if r.start == 0)
    assert sum(r.length for r in rows) == 3 + 3 + 2


def test_sequences_are_put_together(spark, documents):
    docs = documents(*((k, "word " * (37 * k)) for k in range(60)))
    pieces = packing.pack(docs, PATH, 1)
    parts = defaultdict(list)
    for r in pieces.collect():
        parts[r.sequence_id].append((r.offset, bytes(r.ids), r.doc_id))
    made = packing.sequences(pieces, pad_id=50_256).collect()
    assert len(made) == len(parts)
    for r in made:
        whole = b"".join(ids for _, ids, _ in sorted(parts[r.sequence_id]))
        n = len(whole) // 4
        room = n if n & (n - 1) == 0 else packing.CAPACITY
        assert r.n_tokens == n and len(r.ids) == 4 * room
        assert bytes(r.ids) == whole + np.full(room - n, 50_256, "<u4").tobytes()
        assert r.doc_ids == [d for _, _, d in sorted(parts[r.sequence_id])]


@pytest.mark.parametrize("rows", [1, 40])
def test_query(spark, saved, documents, rows):
    sf_dir = saved(documents=documents(*((k, f"text {k} " * k) for k in range(rows))))
    out = packing.op11_harmonic_packing(spark, sf_dir).collect()
    for r in out:
        ids = np.array(TOKENIZER.encode(f"text {r.doc_id} " * r.doc_id).ids + [1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
