from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from adtally.llm import packed_ids
from adtally.llm.packed_ids import PackedFile, bits_for, encode_file, pack, unpack
from adtally.llm.queries import QUERIES
from conftest import SF_DIR
from llm_fixtures import documents, saved  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def expected(rows):
    """By the library on whole texts, one document after another."""
    out, start = {}, 0
    for doc_id, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def result(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


@pytest.mark.parametrize("size,bits", [(2, 1), (3, 2), (49408, 16), (65537, 17), (1, 1)])
def test_bits_for(size, bits):
    assert bits_for(size) == bits


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(bits, values):
    ids = np.array([v & (2**bits - 1) for v in values], np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert unpack(data, bits, len(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [13, 16, 17])
def test_random_access(bits):
    rng = np.random.default_rng(3)
    lengths = [0, 1, 5000, 4096, 7, 20000]
    ids = rng.integers(0, 2**bits, sum(lengths)).astype(np.uint32)
    held = PackedFile(io.BytesIO(encode_file([5, None, 7, 8, 9, 10], lengths, ids, bits)))
    assert held.doc_ids == [5, None, 7, 8, 9, 10]
    at = 0
    for k, n in enumerate(lengths):
        assert held.document(k).tolist() == ids[at : at + n].tolist()
        at += n
    assert held.ids(4095, 4098).tolist() == ids[4095:4098].tolist()


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(text):
    got = np.frombuffer(packed_ids.encoder(PATH)([text])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["a b ̈c\x1cd\x85e", "x<|endoftext|>y <|startoftext|>", "ΑΣ Σ İI", "it's 12.5 z"],
)
def test_odd_texts(text):
    got = np.frombuffer(packed_ids.encoder(PATH)([text])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 30])
def test_small_tables_give_the_same_ids(monkeypatch, size):
    monkeypatch.setattr(packed_ids, "PIECE_CACHE", size)
    encode = packed_ids.PieceEncoder(PATH)
    for i in range(60):
        texts = [f"word{i} again, word{i % 7}. The end{i}!", "the word again"]
        for text, ids in zip(texts, encode(texts)):
            want = TOKENIZER.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = result(QUERIES["op10_packed_ids"](spark, SF_DIR))
    assert got == expected(sorted((r.doc_id, r.text) for r in rows))


def test_nulls_long_texts_repeats_and_small_files(spark, documents, saved, monkeypatch):
    rows = [(9, None), (2, ""), (5, "word " * 30000), (5, "again"), (None, "no id"), (1, " \n")]
    folder = saved(documents=documents(*rows).selectExpr("*", "1 AS START", "2 AS path"))
    monkeypatch.setattr(packed_ids, "FILE_IDS", 3)
    got = [
        (r.doc_id, r.start, r.n_tokens)
        for r in QUERIES["op10_packed_ids"](spark, folder).orderBy("start").collect()
    ]
    assert got == [
        (None, 0, 3), (1, 3, 1), (2, 4, 1), (5, 5, 2), (5, 7, 30001), (9, 30008, 1)
    ]


def test_empty_table(spark, documents, saved):
    empty = documents((1, "x")).where("false")
    assert QUERIES["op10_packed_ids"](spark, saved(documents=empty)).collect() == []
