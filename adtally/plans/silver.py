"""Silver: cast, validate, keep the latest, fit to the contract."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame

from adtally.functions.casting import cast_to
from adtally.functions.rules import DEFAULT_RULES, Rule
from adtally.operators.conform import conform, named_market, silver_defaults
from adtally.operators.dedup import dedup_latest
from adtally.operators.validation import split
from adtally.sources.contracts import EVENT_KEY, SILVER, UNKNOWN_PARTITION


class Silver(NamedTuple):
    events: DataFrame
    rejected: DataFrame


def refine(
    bronze: DataFrame,
    run_ts: datetime,
    rules: Sequence[Rule] = DEFAULT_RULES,
    keys: Sequence[str] = EVENT_KEY,
) -> Silver:
    """Clean, deduplicated events under the strict contract, and the rejects.

    Rows are validated before they are deduplicated: a newer row that is invalid does
    not displace an older valid one, and rejects keep all their copies. A missing or empty
    market gets its stand-in here, for frames and tables alike.
    """
    good, bad = split(cast_to(bronze, SILVER), run_ts, rules)
    latest = named_market(dedup_latest(good, keys))
    return Silver(conform(latest, silver_defaults(run_ts, UNKNOWN_PARTITION)), bad)
