
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adtally.functions.casting import cast_to  # noqa: E402
from adtally.functions.metrics import cost_per_click, ctr  # noqa: E402
from adtally.functions.rules import DEFAULT_RULES, STRICT_RULES, Rule  # noqa: E402
from adtally.operators import checks, dedup, dimensions, history, summaries, validation  # noqa: E402
from adtally.operators.conform import conform, fill_required, silver_defaults  # noqa: E402
from adtally.operators.fact import attach_key, join_side  # noqa: E402
from adtally.operators.pruning import of_members  # noqa: E402
from adtally.operators.skew import join_isolated  # noqa: E402
from adtally.operators.validation import clean, flag, rejected  # noqa: E402
from adtally.plans import gold, sql_models  # noqa: E402
from adtally.plans.bronze import ingest  # noqa: E402
from adtally.plans.merge import LAYOUT, merge_silver  # noqa: E402
from adtally.plans.publish import (  # noqa: E402
    FACT_LAYOUT,
    Lake,
    gold_report,
    publish,
    publish_bronze,
    publish_gold,
)
from adtally.plans.silver import refine  # noqa: E402
from adtally.session import shared_folder  # noqa: E402
from adtally.sources import versions  # noqa: E402
from adtally.sources.contracts import (  # noqa: E402
    BRONZE,
    DIM_MERCHANT,
    EVENT_GRAIN,
    FACT_CAMPAIGN_DAILY,
    REASON,
    SILVER,
    SOURCE,
)
from adtally.sources.given import (  # noqa: E402
    MISSING_VALUES,
    RESENT,
    STRICT_FAULTS,
    TEXT_COLUMNS,
    campaign_events,
    read_given,
    shipped_lines,
    shipped_parts,
)
from adtally.sources.quarantine import read_rejected, write_rejected  # noqa: E402
from adtally.sources.sinks import (  # noqa: E402
    balanced,
    declared,
    overwrite_table,
    replace_directories,
)
from adtally.sources.sized import written  # noqa: E402
from adtally.sources.tables import read_table, typed_scan  # noqa: E402
from oracle_sql import ORACLES  # noqa: E402

# The clock of a run is a parameter of every job; the oracle states the same values.
RUN_TS = datetime(2024, 2, 1, 6, 0, 0)
RUN_DATE = date(2024, 2, 1)
RUN_ID = "run-20240201"
#: The next run, and days whose state dimensions with a history keep.
NEXT_DATE = date(2024, 2, 2)
STATE_DAYS = (date(2024, 1, 11), date(2024, 1, 21), date(2024, 1, 31))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    """Register ``fn``; its timestamps come out as wall-clock times, as in the given files."""

    def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        stamps = [f.name for f in df.schema.fields if f.dataType == TimestampType()]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})

    QUERIES[fn.__name__] = registered
    return fn


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_to(campaign_events(spark, sf_dir), SILVER)


def _typed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_to(campaign_events(spark, sf_dir, MISSING_VALUES), SILVER)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(campaign_events(spark, sf_dir), RUN_TS).events


def _lake(spark: SparkSession) -> Lake:
    """An empty lake with schema names of its own."""
    tag = uuid4().hex[:12]
    lake = Lake(
        shared_folder(spark), bronze=f"bronze_{tag}", silver=f"silver_{tag}", gold=f"gold_{tag}"
    )
    lake.prepare(spark)
    return lake


# --- Sources and bronze ---------------------------------------------------------------


@query
def bronze_typed_scan(spark, sf_dir):
    """Landed files read under the source contract, required columns checked."""
    landed = f"{shared_folder(spark)}/landing"
    campaign_events(spark, sf_dir).select(*SOURCE.names).write.parquet(landed)
    return typed_scan(spark, landed)


@query
def bronze_stamp(spark, sf_dir):
    return ingest(campaign_events(spark, sf_dir).select(*SOURCE.names), RUN_TS)


@query
def bronze_partition_count(spark, sf_dir):
    """Tasks in use after the layout shuffle; depends on the session, so rows-only."""
    return summaries.partitions_in_use(balanced(campaign_events(spark, sf_dir), "market"))


@query
def market_layout(spark, sf_dir):
    """After an explicit shuffle by market, each market's rows are in one task."""
    events = campaign_events(spark, sf_dir).repartition(8, "market")
    return summaries.kept_together(events, "market")


@query
def events_by_market(spark, sf_dir):
    return summaries.rows_by(campaign_events(spark, sf_dir), "market")


@query
def distinct_counts(spark, sf_dir):
    return summaries.distinct_counts(
        campaign_events(spark, sf_dir), ["merchant_id", "campaign_id", "market", "date"]
    )


@query
def cast_columns(spark, sf_dir):
    return cast_to(campaign_events(spark, sf_dir, TEXT_COLUMNS), SILVER)


# --- Rules ----------------------------------------------------------------------------


def _only(*reasons: str) -> list[Rule]:
    return [r for r in DEFAULT_RULES if r.reason in reasons]


@query
def rule_missing(spark, sf_dir):
    rules = _only(
        "missing_merchant_id", "missing_campaign_id", "invalid_or_missing_date", "missing_spend"
    )
    return rejected(_typed_missing(spark, sf_dir), RUN_TS, rules)


@query
def rule_negative_spend(spark, sf_dir):
    return rejected(_typed(spark, sf_dir), RUN_TS, _only("negative_spend"))


@query
def rule_clicks_exceed(spark, sf_dir):
    return rejected(_typed(spark, sf_dir), RUN_TS, _only("clicks_exceed_impressions"))


@query
def rule_negative_balance(spark, sf_dir):
    """A rule over another table: nothing in the split is tied to campaign events."""
    overdrawn = [Rule("negative_balance", "c_acctbal < 0")]
    return rejected(read_given(spark, sf_dir, "customer"), RUN_TS, overdrawn)


@query
def rule_flags(spark, sf_dir):
    return flag(_typed_missing(spark, sf_dir))


@query
def rejection_reason(spark, sf_dir):
    return summaries.rows_by(flag(_typed_missing(spark, sf_dir)), REASON)


@query
def clean_split(spark, sf_dir):
    return clean(_typed_missing(spark, sf_dir))


@query
def rejected_split(spark, sf_dir):
    return rejected(_typed_missing(spark, sf_dir), RUN_TS)


@query
def rejects_by_reason(spark, sf_dir):
    return validation.rejects_by_reason(rejected(_typed(spark, sf_dir), RUN_TS))


@query
def rejects_by_reason_strict(spark, sf_dir):
    events = cast_to(campaign_events(spark, sf_dir, STRICT_FAULTS), SILVER)
    return validation.rejects_by_reason(rejected(events, RUN_TS, STRICT_RULES))


@query
def rejects_by_reason_shipped(spark, sf_dir):
    """No planted faults: line items whose number exceeds their quantity."""
    lines = cast_to(ingest(shipped_lines(spark, sf_dir), RUN_TS), SILVER)
    return validation.rejects_by_reason(rejected(lines, RUN_TS))


@query
def split_is_partition(spark, sf_dir):
    """Rows of the input and of both halves."""
    events = _typed_missing(spark, sf_dir)
    good, bad = validation.split(events, RUN_TS)

    def sized(df, part):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("row_count"))

    return sized(events, "input").unionAll(sized(good, "clean")).unionAll(sized(bad, "rejected"))


# --- Dedup and conform ----------------------------------------------------------------


@query
def dedup_latest(spark, sf_dir):
    return dedup.dedup_latest(clean(_typed(spark, sf_dir)))


@query
def dedup_latest_by_grain(spark, sf_dir):
    return dedup.dedup_latest(clean(_typed(spark, sf_dir)), EVENT_GRAIN)


@query
def dedup_latest_merchant_day(spark, sf_dir):
    """Many copies per key."""
    return dedup.dedup_latest(clean(_typed_missing(spark, sf_dir)), ["merchant_id", "date"])


@query
def dedup_latest_tied(spark, sf_dir):
    """One ingestion time for the whole batch: ties are settled by the other columns."""
    batch = ingest(campaign_events(spark, sf_dir).select(*SOURCE.names), RUN_TS)
    return dedup.dedup_latest(batch, ["merchant_id", "date"])


@query
def dedup_latest_shipped(spark, sf_dir):
    """The last shipment per supplier and day out of one tied batch."""
    lines = cast_to(ingest(shipped_lines(spark, sf_dir), RUN_TS), SILVER)
    return dedup.dedup_latest(clean(lines), ["merchant_id", "date"])


@query
def dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(clean(_typed(spark, sf_dir)))


@query
def dedup_audit(spark, sf_dir):
    return dedup.dedup_audit(clean(_typed_missing(spark, sf_dir)), ["merchant_id", "date"])


@query
def reject_rates(spark, sf_dir):
    return summaries.reject_rates(flag(_typed_missing(spark, sf_dir)))


@query
def coalesce_required(spark, sf_dir):
    return fill_required(_typed_missing(spark, sf_dir), silver_defaults(RUN_TS))


@query
def schema_conform(spark, sf_dir):
    """Bronze rows in another order, with an extra column and narrow counts."""
    bronze = campaign_events(spark, sf_dir, MISSING_VALUES)
    shuffled = bronze.select(F.lit("x").alias("extra"), *reversed(bronze.columns))
    return conform(shuffled, silver_defaults(RUN_TS))


@query
def silver_events(spark, sf_dir):
    return refine(campaign_events(spark, sf_dir, MISSING_VALUES), RUN_TS).events


@query
def silver_events_strict(spark, sf_dir):
    events = campaign_events(spark, sf_dir, STRICT_FAULTS)
    return refine(events, RUN_TS, STRICT_RULES, EVENT_GRAIN).events


# --- Gold -----------------------------------------------------------------------------


@query
def distinct_members(spark, sf_dir):
    return dimensions.distinct_members(_typed(spark, sf_dir), "merchant_id")


@query
def dim_merchant(spark, sf_dir):
    return gold.merchants(_silver(spark, sf_dir), RUN_DATE).table


@query
def dim_market(spark, sf_dir):
    return gold.markets(_silver(spark, sf_dir), RUN_DATE).table


@query
def dim_campaign_part(spark, sf_dir):
    """A wide dimension: every part that was shipped."""
    lines = shipped_parts(spark, sf_dir)
    return dimensions.build_dim(lines, "campaign_id", "campaign_key", RUN_DATE).table


@query
def metric_ctr(spark, sf_dir):
    return _typed_missing(spark, sf_dir).select("impressions", "clicks", ctr())


@query
def metric_cpc(spark, sf_dir):
    return _typed_missing(spark, sf_dir).select("spend", "clicks", cost_per_click())


@query
def fact_join_merchant(spark, sf_dir):
    events = written(_silver(spark, sf_dir), "events").table
    dim = gold.merchants(events, RUN_DATE)
    return attach_key(events, join_side(dim), "merchant_id", "merchant_key")


@query
def fact_join_market(spark, sf_dir):
    events = written(_silver(spark, sf_dir), "events").table
    dim = gold.markets(events, RUN_DATE)
    return attach_key(events, join_side(dim), "market", "market_key")


@query
def fact_campaign_daily(spark, sf_dir):
    return gold.star(_silver(spark, sf_dir), RUN_DATE).fact_campaign_daily


@query
def fact_campaign_daily_shipped(spark, sf_dir):
    """The same over the volume adapter: every line item."""
    events = refine(ingest(shipped_lines(spark, sf_dir), RUN_TS), RUN_TS).events
    return gold.star(events, RUN_DATE).fact_campaign_daily


@query
def fact_campaign_daily_nan(spark, sf_dir):
    """Spend that is not a number passes the default rules, and so do its ratios."""
    events = cast_to(campaign_events(spark, sf_dir, STRICT_FAULTS), SILVER)
    return gold.star(refine(events, RUN_TS).events, RUN_DATE).fact_campaign_daily


@query
def daily_rollup(spark, sf_dir):
    return summaries.daily_rollup(_silver(spark, sf_dir), "market")


@query
def dim_merchant_sql(spark, sf_dir):
    events = _silver(spark, sf_dir)
    return sql_models.dimension(events, "merchant_id", "merchant_key", RUN_DATE).table


@query
def dim_market_sql(spark, sf_dir):
    return sql_models.dimension(_silver(spark, sf_dir), "market", "market_key", RUN_DATE).table


@query
def fact_campaign_daily_sql(spark, sf_dir):
    return sql_models.star(_silver(spark, sf_dir), RUN_DATE).fact_campaign_daily


# --- Data tests -----------------------------------------------------------------------


def _gold_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The star over events with missing measures, so that ratios can be null."""
    events = refine(campaign_events(spark, sf_dir, MISSING_VALUES), RUN_TS).events
    tables = gold.star(events, RUN_DATE)._asdict()
    return {name: written(table, name).table for name, table in tables.items()}


@query
def dq_not_null(spark, sf_dir):
    return checks.null_counts(_typed_missing(spark, sf_dir), SILVER.names)


@query
def dq_unique(spark, sf_dir):
    """Merchants with more than one event on the books."""
    return checks.repeated_values(_typed_missing(spark, sf_dir), "merchant_id")


@query
def dq_relationships(spark, sf_dir):
    """Campaigns in the events that no part stands for: none in the given tables."""
    events = _typed_missing(spark, sf_dir)
    shipped = dimensions.distinct_members(shipped_parts(spark, sf_dir), "campaign_id")
    return checks.orphans(events, "campaign_id", shipped, "campaign_id")


@query
def dq_orphan_parts(spark, sf_dir):
    """Shipped parts without a campaign in the events: many."""
    campaigns = dimensions.distinct_members(_typed_missing(spark, sf_dir), "campaign_id")
    return checks.orphans(shipped_parts(spark, sf_dir), "campaign_id", campaigns, "campaign_id")


@query
def dq_report_with_failures(spark, sf_dir):
    """The declared tests on a star whose markets lost a member and whose merchants repeat."""
    tables = _gold_tables(spark, sf_dir)
    merchants, markets = tables["dim_merchant"], tables["dim_market"]
    tables["dim_merchant"] = merchants.unionAll(merchants.where("merchant_key <= 3"))
    tables["dim_market"] = markets.where("market_key <> 2")
    return checks.run_checks(tables, checks.GOLD_CHECKS)


@query
def dq_report(spark, sf_dir):
    return checks.run_checks(_gold_tables(spark, sf_dir), checks.GOLD_CHECKS)


# --- Tables: written, then read back --------------------------------------------------


@query
def silver_scan(spark, sf_dir):
    """A catalog table scan."""
    lake = _lake(spark)
    overwrite_table(_silver(spark, sf_dir), lake.silver_events, contract=SILVER)
    return read_table(spark, lake.silver_events)


@query
def sink_bronze_roundtrip(spark, sf_dir):
    lake = _lake(spark)
    publish_bronze(campaign_events(spark, sf_dir), lake, RUN_TS, keep_stamp=True)
    return read_table(spark, lake.bronze_events, BRONZE)


@query
def sink_silver_roundtrip(spark, sf_dir):
    """Includes rows without a market, which have a stand-in as their directory's name."""
    lake = _lake(spark)
    events = refine(campaign_events(spark, sf_dir, MISSING_VALUES), RUN_TS).events
    overwrite_table(events, lake.silver_events, ["market", "date"], SILVER)
    return read_table(spark, lake.silver_events, SILVER)


@query
def sink_rejected_roundtrip(spark, sf_dir):
    """The same run twice, which leaves one copy of its rejects."""
    lake = _lake(spark)
    rejects = refine(campaign_events(spark, sf_dir), RUN_TS).rejected
    for _ in range(2):
        write_rejected(rejects, lake.rejected_path, RUN_ID)
    return read_rejected(spark, lake.rejected_path)


@query
def quarantine_by_name(spark, sf_dir):
    """Rejects per reason, read from the quarantine's catalog table."""
    lake = _lake(spark)
    rejects = refine(campaign_events(spark, sf_dir), RUN_TS).rejected
    write_rejected(rejects, lake.rejected_path, RUN_ID, lake.fmt, lake.rejected_table)
    return validation.rejects_by_reason(read_table(spark, lake.rejected_table))


@query
def sink_failed_overwrite(spark, sf_dir):
    """A replacement that fails in its tasks: the table still has its rows."""
    lake = _lake(spark)
    events = _silver(spark, sf_dir)
    overwrite_table(events, lake.silver_events, ["market", "date"], SILVER)
    failing = F.when(F.col("clicks") >= 0, F.raise_error(F.lit("planned")).cast("double"))
    try:
        overwrite_table(
            events.withColumn("spend", failing), lake.silver_events, ["market", "date"], SILVER
        )
    except Exception as failure:
        if "planned" not in str(failure):
            raise
        return read_table(spark, lake.silver_events, SILVER)
    raise AssertionError("the overwrite did not fail")


@query
def sink_dim_roundtrip(spark, sf_dir):
    lake = _lake(spark)
    name = lake.gold_table("dim_merchant")
    dim = declared(gold.merchants(_silver(spark, sf_dir), RUN_DATE).table, DIM_MERCHANT)
    overwrite_table(dim, name, contract=DIM_MERCHANT)
    return read_table(spark, name)


@query
def sink_fact_unknown_market(spark, sf_dir):
    """Events without a market, as tables: the same keys as in the frames."""
    lake = _lake(spark)
    events = refine(campaign_events(spark, sf_dir, MISSING_VALUES), RUN_TS).events
    overwrite_table(events, lake.silver_events, ["market", "date"], SILVER)
    publish_gold(spark, lake, RUN_DATE)
    return read_table(spark, lake.gold_table("fact_campaign_daily"))


@query
def sink_fact_roundtrip(spark, sf_dir):
    lake = _lake(spark)
    overwrite_table(_silver(spark, sf_dir), lake.silver_events, ["market", "date"], SILVER)
    publish_gold(spark, lake, RUN_DATE)
    return read_table(spark, lake.gold_table("fact_campaign_daily"))


@query
def sink_sql_model_roundtrip(spark, sf_dir):
    """SQL models as tables, built twice: a rebuild replaces."""
    lake = _lake(spark)
    name = lake.gold_table("fact_campaign_daily")
    for _ in range(2):
        fact = declared(sql_models.star(_silver(spark, sf_dir), RUN_DATE)[2], FACT_CAMPAIGN_DAILY)
        overwrite_table(fact, name, contract=FACT_CAMPAIGN_DAILY)
    return read_table(spark, name)


@query
def partition_pruned_read(spark, sf_dir):
    """One market's January week: only those directories are opened."""
    lake = _lake(spark)
    overwrite_table(_silver(spark, sf_dir), lake.silver_events, ["market", "date"], SILVER)
    return read_table(spark, lake.silver_events, SILVER).where(
        "market = 'click' AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"
    )


@query
def sink_read_across_replacement(spark, sf_dir):
    """A read that was planned before a replacement: the rows of the version before it."""
    lake = _lake(spark)
    events = refine(campaign_events(spark, sf_dir, MISSING_VALUES), RUN_TS).events
    overwrite_table(events, lake.silver_events, LAYOUT, SILVER)
    planned = read_table(spark, lake.silver_events, SILVER)
    overwrite_table(_silver(spark, sf_dir).limit(1), lake.silver_events, LAYOUT, SILVER)
    return planned


def _merged_lake(spark, sf_dir) -> Lake:
    """Silver of all events, into which the last ten days were merged once more, as resent."""
    lake = _lake(spark)
    merge_silver(campaign_events(spark, sf_dir), lake, RUN_TS, "run-first")
    late = campaign_events(spark, sf_dir, RESENT).where("date >= DATE '2024-01-21'")
    merge_silver(late, lake, RUN_TS, "run-late")
    return lake


@query
def silver_late_batch(spark, sf_dir):
    """Two batches merged one after another: what one rebuild over both gives."""
    return read_table(spark, _merged_lake(spark, sf_dir).silver_events, SILVER)


@query
def late_batch_directories(spark, sf_dir):
    """Silver's directories after the merge, and which of them kept their files."""
    lake = _merged_lake(spark, sf_dir)
    now, before = (
        versions.directories(spark, v, LAYOUT) for v in versions.chain(spark, lake.silver_events)
    )
    rows = [(*versions.values_of(n), before.get(n) == at) for n, at in now.items()]
    listed = spark.createDataFrame(rows, "market STRING, date STRING, kept BOOLEAN")
    return listed.withColumn("date", F.col("date").cast("date"))


@query
def quarantine_widened(spark, sf_dir):
    """Two runs of which the second has wider counts: one table with all rows."""
    lake = _lake(spark)
    narrow = campaign_events(spark, sf_dir).where("market IN ('click', 'view', 'error')")
    wide = _typed(spark, sf_dir).where("market NOT IN ('click', 'view', 'error')")
    for run, rows in (("run-narrow", narrow), ("run-wide", wide)):
        write_rejected(
            rejected(rows, RUN_TS), lake.rejected_path, run, lake.fmt, lake.rejected_table
        )
    return read_table(spark, lake.rejected_table)


def _first_day(events: DataFrame) -> DataFrame:
    return events.where("date = DATE '2024-01-01'")


@query
def dim_merchant_stable(spark, sf_dir):
    """Merchants of the first day, then those of all days: the first keep their keys."""
    events = written(_silver(spark, sf_dir), "events").table
    known = gold.merchants(_first_day(events), RUN_DATE)
    return dimensions.extend_dim(known, events, "merchant_id", "merchant_key", NEXT_DATE).table


@query
def sink_fact_stable_keys(spark, sf_dir):
    """The same in tables: the fact of the second run has the first run's keys."""
    lake = _lake(spark)
    for run_date, part in ((RUN_DATE, _first_day), (NEXT_DATE, lambda events: events)):
        overwrite_table(part(_silver(spark, sf_dir)), lake.silver_events, LAYOUT, SILVER)
        publish_gold(spark, lake, run_date, stable_keys=True)
    return read_table(spark, lake.gold_table("fact_campaign_daily"))


def _home_markets(spark, events: DataFrame) -> DataFrame:
    """Each merchant's market on its newest event of ten days, as a history over three states."""
    homes = events.withColumnRenamed("market", "home_market")
    found = None
    for day in STATE_DAYS:
        days = homes.where(F.col("date").between(F.date_sub(F.lit(day), 10), F.date_sub(F.lit(day), 1)))
        now = history.state(days, "merchant_id", ["home_market"], ["ingestion_ts"])
        if found is None:
            made = history.first_history(now, "merchant_id", ["home_market"], day)
        else:
            made = history.next_history(found, now, "merchant_id", ["home_market"], day)
        found = written(made, "history").table
    return found


@query
def dim_merchant_history(spark, sf_dir):
    """Versions of merchants by intervals of days; merchants without events are gone."""
    return _home_markets(spark, written(_silver(spark, sf_dir), "events").table)


@query
def fact_point_in_time(spark, sf_dir):
    """Events with the version of their merchant that held on their day."""
    events = written(_silver(spark, sf_dir), "events").table
    homes = _home_markets(spark, events)
    columns = ["home_market", history.VALID_FROM]
    return history.attach_valid(events, homes, "merchant_id", columns).select(
        "merchant_id", "campaign_id", "market", "date", "spend", *columns
    )


@query
def fact_by_market_name(spark, sf_dir):
    """The fact's rows of two markets by name: only their directories are opened."""
    lake = _lake(spark)
    overwrite_table(_silver(spark, sf_dir), lake.silver_events, LAYOUT, SILVER)
    publish_gold(spark, lake, RUN_DATE)
    fact, dim = (spark.table(lake.gold_table(t)) for t in ("fact_campaign_daily", "dim_market"))
    wanted = F.col("market").isin("click", "view")
    return of_members(fact, dim.select("market_key", "market"), "market_key", wanted)


@query
def silver_of_one_merchant(spark, sf_dir):
    """One merchant's events out of directories that are ordered by merchant."""
    lake = _lake(spark)
    events = _silver(spark, sf_dir)
    overwrite_table(events, lake.silver_events, ["market"], SILVER, cluster_by=["merchant_id"])
    return read_table(spark, lake.silver_events, SILVER).where("merchant_id = '8'")


@query
def fact_join_hot_merchant(spark, sf_dir):
    """A third of all line items under one supplier, joined to a dimension by a shuffle."""
    lines = shipped_lines(spark, sf_dir).withColumn(
        "merchant_id", F.expr("IF(clicks % 3 = 0, '1', merchant_id)")
    )
    events = written(lines.select("merchant_id", "campaign_id", "date", "spend"), "lines").table
    dim = gold.merchants(events, RUN_DATE).table.select("merchant_id", "merchant_key")
    return join_isolated(events, dim, "merchant_id").drop("merchant_id")


@query
def dq_report_incremental(spark, sf_dir):
    """The report after one day's facts changed, from profiles of the days before."""
    lake = _lake(spark)
    overwrite_table(_silver(spark, sf_dir), lake.silver_events, LAYOUT, SILVER)
    publish_gold(spark, lake, RUN_DATE)
    gold_report(spark, lake, incremental=True)
    name = lake.gold_table("fact_campaign_daily")
    day = spark.table(name).where("date = DATE '2024-01-10'")
    broken = day.withColumns({"ctr": F.expr("nullif(ctr, 0.0)"), "merchant_key": -F.col("merchant_key")})
    places = versions.directories(spark, versions.current_version(spark, name), FACT_LAYOUT)
    touched = [n for n in places if n.endswith("date=2024-01-10")]
    replace_directories(
        declared(broken.select(*FACT_CAMPAIGN_DAILY.names), FACT_CAMPAIGN_DAILY),
        name, FACT_LAYOUT, touched, FACT_CAMPAIGN_DAILY,
    )
    return gold_report(spark, lake, incremental=True)


@query
def preview_topn(spark, sf_dir):
    return summaries.preview(_silver(spark, sf_dir), SILVER.names, 10)


@query
def layer_counts(spark, sf_dir):
    """Rows written per layer, as observed by the writes themselves."""
    counts = publish(campaign_events(spark, sf_dir), _lake(spark), RUN_TS, RUN_DATE, RUN_ID)
    return spark.createDataFrame(list(counts.items()), "layer STRING, row_count BIGINT")


#: The queries of the library itself.
LIBRARY = frozenset(QUERIES)

# --- Training data: present only with its subpackage and the pipeline ---------------------

try:
    import corpus_pipeline
    from adtally.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "adtally.llm"):
        raise
else:
    QUERIES |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    ORACLES |= llm_queries.ORACLES
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """The daily fact, from raw events to the star."""
    return QUERIES["fact_campaign_daily"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
