"""Validation rules: a named predicate that is true where a row breaks it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from adtally.sources.contracts import UNKNOWN_PARTITION, UNKNOWN_TEXT


class Rule(NamedTuple):
    reason: str
    broken: str  # SQL predicate; null counts as kept

    def flag(self) -> Column:
        """The reason where the rule is broken, else null."""
        return F.when(F.expr(self.broken), F.lit(self.reason)).alias(f"_fail_{self.reason}")

    def kept(self) -> Column:
        return ~F.coalesce(F.expr(self.broken), F.lit(False))


# --- Fixed values: reason codes, their predicates and their order ---------------------
DEFAULT_RULES = (
    Rule("missing_merchant_id", "merchant_id IS NULL"),
    Rule("missing_campaign_id", "campaign_id IS NULL"),
    Rule("invalid_or_missing_date", "date IS NULL"),
    Rule("missing_spend", "spend IS NULL"),
    Rule("negative_spend", "spend < 0"),
    Rule("clicks_exceed_impressions", "clicks > impressions"),
)

#: Faults the default rules let pass; strict mode rejects them too.
STRICT_RULES = (
    *DEFAULT_RULES,
    Rule(
        "missing_market",
        f"market IS NULL OR market IN ('{UNKNOWN_TEXT}', '{UNKNOWN_PARTITION}')",
    ),
    Rule("missing_ingestion_ts", "ingestion_ts IS NULL"),
    Rule("spend_not_a_number", "isnan(spend)"),
    Rule("negative_impressions", "impressions < 0"),
    Rule("negative_clicks", "clicks < 0"),
)


def reason(rules: Sequence[Rule]) -> Column:
    """All broken rules in order, comma-joined; empty for a good row.

    ``concat_ws`` skips nulls by itself and stays inside generated code, which an array
    filtered by a lambda would not.
    """
    return F.concat_ws(",", *[rule.flag() for rule in rules])


def all_kept(rules: Sequence[Rule]) -> Column:
    """True exactly where ``reason`` is empty, without building the text.

    As plain predicates the null checks reach the Parquet reader.
    """
    return reduce(and_, [rule.kept() for rule in rules], F.lit(True))


def any_broken(rules: Sequence[Rule]) -> Column:
    """A filter for the rows ``all_kept`` leaves out: null where no rule is surely broken.

    Reaches the Parquet reader whole if each rule compares a column with a constant.
    """
    return reduce(or_, [F.expr(rule.broken) for rule in rules], F.lit(False))
