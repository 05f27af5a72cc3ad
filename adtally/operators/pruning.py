"""Reads of a fact by the names of its members, which open the wanted directories alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.operators.fact import BROADCAST_LIMIT, join_side
from adtally.sources.sized import Size, Sized, row_bytes


def of_members(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    wanted: Column,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """The fact's rows of the members that ``wanted`` picks, with the members' columns.

    The fact's directories are named by surrogate key, so a filter by name cannot prune them by
    itself. Joined with the members found, Spark hands their keys to the scan before it opens a
    file (dynamic partition pruning), out of the same broadcast that the join uses. The members
    are measured first; beyond ``limit`` they are joined by a shuffle, and all files are read.
    """
    members = dim.where(wanted)
    rows, size = members.agg(F.count(F.lit(1)), F.sum(row_bytes(members))).first()
    return fact.join(join_side(Sized(members, Size(rows, size or 0)), limit), key)
