from __future__ import annotations

import pytest

import corpus_pipeline
from adtally.llm import merge_dropout, near_dedup, private_data
from adtally.llm.common import stored
from llm_fixtures import documents, saved  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gave, by name, the documents first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_the_five(stages):
    assert list(stages) == [
        "documents", "toxicity", "near_duplicates", "private_data", "mixing", "pieces"
    ]
    columns = stages["documents"].columns
    assert all(df.columns == columns for name, df in stages.items() if name != "pieces")


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = set(rows(stages["toxicity"]))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    bad = [x.doc_id for x in labels if x.toxic == 1]
    good = [x.doc_id for x in labels if x.toxic == 0]
    assert sum(d in kept for d in good) / len(good) > 0.99
    assert sum(d in kept for d in bad) / len(bad) < 0.2


def test_one_of_each_group_stays(stages):
    before, after = rows(stages["toxicity"]), rows(stages["near_duplicates"])
    found = near_dedup.near_duplicates(stages["toxicity"], 80).collect()
    assert set(after) == {r.doc_id for r in found if r.kept}
    assert {r.component_id for r in found} == set(after)
    assert all(after[d].text == before[d].text for d in after)


def test_private_data_is_hidden(stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["private_data"])
    assert set(before) == set(after)
    hidden = 0
    for d, row in after.items():
        assert not private_data.base_spans(row.text) and row.n_chars == len(row.text)
        if private_data.base_spans(before[d].text):
            hidden += 1
        elif not any(f"<{k.upper()}>" in row.text for k in private_data.KINDS):
            assert row.text == before[d].text
    assert hidden


def test_mixing_keeps_whole_rows(stages):
    before, after = rows(stages["private_data"]), rows(stages["mixing"])
    assert 0 < len(after) < len(before)
    assert all(after[d] == before[d] for d in after)


def test_pieces_decode_to_the_texts(stages):
    pieces = merge_dropout.Pieces(merge_dropout.model_path())
    for row in stages["pieces"].collect():
        assert pieces.decode(row.pieces) == row.text


def test_odd_rows_pass_through(spark, documents, saved):  # noqa: F811
    some = [(1, None), (2, ""), (None, "a b c"), (3, "x " * 40_000), (3, "x " * 40_000)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    folder = saved(documents=documents(*some), labels=labels)
    out = corpus_pipeline.run(spark, folder)
    assert set(documents(*some).columns) < set(out.columns)
    assert out.count() <= 4


def test_each_stage_keeps_odd_rows(spark, documents, saved):  # noqa: F811
    """Stage by stage, with columns whose names the operators use themselves."""
    some = [(1, None), (2, ""), (None, "a b c"), (3, "x " * 40_000), (3, "x " * 40_000)]
    docs = documents(*some).selectExpr("*", "7 AS score", "8 AS component_id", "9 AS Spans")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    folder = saved(labels=labels)
    every = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert set(docs.columns) <= set(out.columns), name
        found = out.collect()
        assert all((r.score, r.component_id, r.Spans) == (7, 8, 9) for r in found)
        got = sorted((r.doc_id or 0, r.text or "") for r in found)
        if name == "near_duplicates":
            assert len(got) < 5 and set(got) == set(every)
        elif name != "mixing":
            assert got == every, name


def test_empty_tables_pass_through(spark, documents, saved):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    folder = saved(documents=documents((1, "x")).where("false"), labels=labels)
    assert corpus_pipeline.run(spark, folder).collect() == []
