"""Stages that turn the documents table into training data, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adtally.llm import merge_dropout, mixing, near_dedup, private_data, toxicity
from adtally.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least similarity, in percent, of two texts that count as one.
SIMILAR = 80
#: Tokens that mixing draws, as a share of those it gets.
BUDGET = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers do not take as toxic.

    Null and empty texts, null ids and repeated rows are scored as rows of their own.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs, SIMILAR)


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with tags in place of personal data."""
    return private_data.redact(docs, private_data.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, each once; further copies would bring duplicates back."""
    drawn = mixing.mix(docs, budget=BUDGET, once=True)
    return drawn.where(drawn[drawn.columns[-1]] > 0).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces, cut with dropout; the pieces decode to the texts.

    Null and empty texts, null ids and repeated rows all stay.
    """
    return merge_dropout.encode_documents(
        docs, merge_dropout.model_path(), merge_dropout.DROPOUT, merge_dropout.SEED
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each),
    ("private_data", hide_private_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: None: the stages train models and draw by what they find, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage_{k}")
    return docs
