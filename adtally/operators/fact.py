"""The daily campaign fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.functions.metrics import cost_per_click, ctr
from adtally.operators.skew import join_isolated
from adtally.sources.sized import Size, Sized

#: A dimension whose hash table takes up to this many bytes is sent to every executor.
BROADCAST_LIMIT = 128 * 1024 * 1024

#: What the fact needs of the events.
EVENT_COLUMNS = (
    "merchant_id", "campaign_id", "market", "date", "spend", "impressions", "clicks"
)

# A row of a broadcast's hash table beside its values: two row headers, a record's lengths
# and pointer, and up to four words in an array that is kept at most half full.
_ROW_BYTES = 128


def broadcast_bytes(size: Size) -> int:
    """Upper estimate of a broadcast's size: the key is held once more beside its row."""
    return _ROW_BYTES * size.rows + 2 * size.bytes


def fits_broadcast(size: Size, limit: int = BROADCAST_LIMIT) -> bool:
    return broadcast_bytes(size) <= limit


def broadcast_limit(spark: SparkSession, limit: int = BROADCAST_LIMIT) -> int:
    """``limit``, or -1 in a session that has broadcast joins switched off."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")
    return -1 if threshold.strip().startswith("-") else limit


def join_side(dim: Sized, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The dimension, marked for broadcast if its measured size allows it.

    A larger one is joined by a shuffle, where adaptive execution splits a member that
    holds many rows (``spark.sql.adaptive.skewJoin``).
    """
    limit = broadcast_limit(dim.table.sparkSession, limit)
    return F.broadcast(dim.table) if fits_broadcast(dim.size, limit) else dim.table


def attach_key(events: DataFrame, dim: DataFrame, natural_key: str, key_name: str) -> DataFrame:
    """Inner equi-join that brings in a surrogate key."""
    return events.join(dim.select(natural_key, key_name), natural_key)


def attach_member(
    events: DataFrame, dim: Sized, natural_key: str, key_name: str, limit: int
) -> DataFrame:
    """``attach_key`` by a broadcast where the dimension's size allows it; else by a shuffle
    from which members with many events are set apart."""
    limit = broadcast_limit(dim.table.sparkSession, limit)
    if fits_broadcast(dim.size, limit) or limit < 0:
        return attach_key(events, join_side(dim, limit), natural_key, key_name)
    members = dim.table.select(natural_key, key_name)
    return join_isolated(events, members, natural_key)


def build_fact(
    events: DataFrame,
    merchants: Sized,
    markets: Sized,
    limit: int = BROADCAST_LIMIT,
    isolate_hot: bool = False,
) -> DataFrame:
    """Surrogate keys in place of natural ones, the measures, and the two ratios.

    A merchant dimension beyond the broadcast limit is joined by a shuffle. With
    ``isolate_hot`` merchants with many events are set apart there, which takes two further
    scans of the events; else it is left to adaptive execution to split them.
    """
    if isolate_hot:
        keyed = attach_member(events, merchants, "merchant_id", "merchant_key", limit)
    else:
        keyed = attach_key(events, join_side(merchants, limit), "merchant_id", "merchant_key")
    keyed = attach_key(keyed, join_side(markets, limit), "market", "market_key")
    return keyed.select(
        "merchant_key",
        "market_key",
        "campaign_id",
        "date",
        "spend",
        "impressions",
        "clicks",
        ctr(),
        cost_per_click(),
    )
