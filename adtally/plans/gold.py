"""Gold: two dimensions and the daily fact."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame

from adtally.operators.dimensions import build_dim
from adtally.operators.fact import BROADCAST_LIMIT, EVENT_COLUMNS, build_fact
from adtally.sources.sized import Sized, written


class Star(NamedTuple):
    dim_merchant: DataFrame
    dim_market: DataFrame
    fact_campaign_daily: DataFrame


def merchants(events: DataFrame, run_date: date) -> Sized:
    return build_dim(events, "merchant_id", "merchant_key", run_date)


def markets(events: DataFrame, run_date: date) -> Sized:
    return build_dim(events, "market", "market_key", run_date)


def star(events: DataFrame, run_date: date, limit: int = BROADCAST_LIMIT) -> Star:
    """The star over ``events``, of which the fact's columns are written first.

    Three steps read the events; computed from the raw source each would repeat the
    dedup's shuffle. Keys are rebuilt with every run, so the fact is too.
    """
    events = written(events.select(*EVENT_COLUMNS), "events").table
    by_merchant, by_market = merchants(events, run_date), markets(events, run_date)
    fact = build_fact(events, by_merchant, by_market, limit)
    return Star(by_merchant.table, by_market.table, fact)
