"""Ratios of the daily fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The ratio as SQL, for frames and for SQL models.
GUARDED_RATIO = "CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE CAST(0 AS DOUBLE) END"
CTR = GUARDED_RATIO.format(part="clicks", whole="impressions")
COST_PER_CLICK = GUARDED_RATIO.format(part="spend", whole="clicks")


def guarded_ratio(part: str, whole: str) -> Column:
    """``part / whole`` where ``whole`` is positive, else 0.0.

    A null or non-positive ``whole`` gives 0.0; a null ``part`` over a positive
    ``whole`` stays null. Under ANSI mode the guard is what keeps a zero from failing
    the job.
    """
    return F.expr(GUARDED_RATIO.format(part=part, whole=whole))


def ctr() -> Column:
    return F.expr(CTR).alias("ctr")


def cost_per_click() -> Column:
    return F.expr(COST_PER_CLICK).alias("cost_per_click")
