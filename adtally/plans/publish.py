"""All layers as tables, each written once and read by the next."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from adtally.functions.rules import DEFAULT_RULES, Rule
from adtally.operators.checks import GOLD_CHECKS, run_checks, wanted_of
from adtally.operators.conform import named_market
from adtally.operators.dimensions import extend_dim
from adtally.operators.fact import (
    BROADCAST_LIMIT,
    broadcast_limit,
    build_fact,
    fits_broadcast,
)
from adtally.operators.profiles import stored_profile
from adtally.plans.bronze import ingest
from adtally.plans.gold import markets, merchants
from adtally.plans.silver import refine
from adtally.sources.contracts import (
    BRONZE,
    DIM_MARKET,
    DIM_MERCHANT,
    EVENT_KEY,
    FACT_CAMPAIGN_DAILY,
    SILVER,
)
from adtally.sources.quarantine import write_rejected
from adtally.sources.sinks import declared, overwrite_table
from adtally.sources.sized import Size, Sized
from adtally.sources.tables import ensure_schema, qualified, read_table


#: The directories of the fact.
FACT_LAYOUT = ("market_key", "date")


class Lake(NamedTuple):
    """Where the layers live. ``root`` places the schemas and the quarantine."""

    root: str
    catalog: str = "spark_catalog"
    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    fmt: str = "parquet"

    def prepare(self, spark: SparkSession) -> None:
        for schema in (self.bronze, self.silver, self.gold):
            ensure_schema(spark, self.catalog, schema, f"{self.root}/{schema}")

    @property
    def bronze_events(self) -> str:
        return qualified(self.catalog, self.bronze, "campaign_events")

    @property
    def silver_events(self) -> str:
        return qualified(self.catalog, self.silver, "campaign_events")

    @property
    def rejected_path(self) -> str:
        return f"{self.root}/{self.silver}_rejected"

    @property
    def rejected_table(self) -> str:
        return qualified(self.catalog, self.silver, "campaign_events_rejected")

    def gold_table(self, table: str) -> str:
        return qualified(self.catalog, self.gold, table)


def publish_bronze(
    source: DataFrame, lake: Lake, run_ts: datetime, keep_stamp: bool = False
) -> int:
    events = named_market(ingest(source, run_ts, keep_stamp=keep_stamp))
    return overwrite_table(events, lake.bronze_events, ["market"], BRONZE, lake.fmt).rows


def publish_silver(
    spark: SparkSession,
    lake: Lake,
    run_ts: datetime,
    run_id: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    keys: Sequence[str] = EVENT_KEY,
    cluster_by: Sequence[str] = (),
) -> tuple[int, int]:
    """Rows of silver and of this run's quarantine.

    The quarantine goes first: it can be repeated, so a failure in or before the second
    write leaves the previous silver table in place and no reject lost.
    """
    silver = refine(read_table(spark, lake.bronze_events, BRONZE), run_ts, rules, keys)
    rejected = write_rejected(
        silver.rejected, lake.rejected_path, run_id, lake.fmt, lake.rejected_table
    )
    events = overwrite_table(
        silver.events, lake.silver_events, ["market", "date"], SILVER, lake.fmt,
        cluster_by=cluster_by,
    )
    return events.rows, rejected.rows


def publish_gold(
    spark: SparkSession,
    lake: Lake,
    run_date: date,
    limit: int = BROADCAST_LIMIT,
    stable_keys: bool = False,
    isolate_hot: bool = False,
) -> dict[str, int]:
    """Rows of the dimensions and the fact; the fact joins the written dimensions.

    With ``stable_keys``, members of the published dimensions keep their keys, and new ones
    are numbered above them; else each run numbers all members anew.

    The market's key follows from the market, so silver's directories map one to one to
    the fact's. With both dimensions small enough to broadcast, rows stay with the files
    they came in and the fact is written without any shuffle: at most one file for each
    piece of a silver file. A shuffled join scatters them, and they are laid out anew.
    """
    events = read_table(spark, lake.silver_events, SILVER)
    limit = broadcast_limit(spark, limit)
    dims = []
    for name, dim, contract in (
        ("dim_merchant", merchants, DIM_MERCHANT),
        ("dim_market", markets, DIM_MARKET),
    ):
        if stable_keys and spark.catalog.tableExists(lake.gold_table(name)):
            known = Sized(spark.table(lake.gold_table(name)), Size(0, 0))
            key, member = contract.names[:2]
            made = extend_dim(known, events, member, key, run_date)
        else:
            made = dim(events, run_date)
        frame = declared(made.table, contract)
        size = overwrite_table(frame, lake.gold_table(name), contract=contract, fmt=lake.fmt)
        dims.append(Sized(spark.table(lake.gold_table(name)), size))
    fact = overwrite_table(
        declared(build_fact(events, *dims, limit, isolate_hot), FACT_CAMPAIGN_DAILY),
        lake.gold_table("fact_campaign_daily"),
        FACT_LAYOUT,
        FACT_CAMPAIGN_DAILY,
        fmt=lake.fmt,
        laid_out=all(fits_broadcast(dim.size, limit) for dim in dims),
    )
    return {
        "dim_merchant": dims[0].size.rows,
        "dim_market": dims[1].size.rows,
        "fact_campaign_daily": fact.rows,
    }


def publish(
    source: DataFrame,
    lake: Lake,
    run_ts: datetime,
    run_date: date,
    run_id: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    keys: Sequence[str] = EVENT_KEY,
    limit: int = BROADCAST_LIMIT,
    keep_stamp: bool = False,
    stable_keys: bool = False,
) -> dict[str, int]:
    """Write every layer and return the rows written to each, without a counting pass."""
    spark = source.sparkSession
    lake.prepare(spark)
    counts = {"bronze": publish_bronze(source, lake, run_ts, keep_stamp)}
    counts["silver"], counts["rejected"] = publish_silver(spark, lake, run_ts, run_id, rules, keys)
    return counts | publish_gold(spark, lake, run_date, limit, stable_keys)


def gold_report(spark: SparkSession, lake: Lake, incremental: bool = False) -> DataFrame:
    """The declared tests on the published gold tables: failures per check.

    An incremental report keeps a profile of the fact's directories as a table beside it, and
    reads those that changed since the last such report.
    """
    tables = {c.table: spark.table(lake.gold_table(c.table)) for c in GOLD_CHECKS}
    if not incremental:
        return run_checks(tables, GOLD_CHECKS)
    fact = "fact_campaign_daily"
    known = stored_profile(
        spark,
        lake.gold_table(fact),
        lake.gold_table(f"{fact}_profile"),
        FACT_LAYOUT,
        *wanted_of(GOLD_CHECKS, fact),
    )
    return run_checks(tables, GOLD_CHECKS, {fact: known})
