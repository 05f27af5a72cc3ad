"""Connected components of a graph of numbered nodes, by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.common import stored


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One step: neighbours of a node are tied to the smallest of them and the node.

    Over all neighbours, those larger than the node move; over the smaller ones, all and the
    node itself do. Smallest neighbours are found by a sum that combines before its shuffle,
    and meet the edges in a join, which adaptive execution splits at a hot node.
    """
    if larger_only:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = edges.join(least, "u")
    if larger_only:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    """A digest of the edges, without their order."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges (u, v)``: the smallest node it reaches.

    Large-star and small-star steps alternate until the edges stay as they are, which takes
    about as many rounds as the logarithm of the number of nodes. Every round is written, so
    that lineage stays short; only two digests reach the driver.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stored(_stars(_stars(edges, True), False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.unionAll(centres.distinct())
