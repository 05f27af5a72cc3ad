from __future__ import annotations

import glob

import pytest
from conftest import RUN_DATE, RUN_TS, SF_DIR, plan_of
from pyspark.sql import functions as F

from adtally.__main__ import parse, run
from adtally.operators.conform import SchemaMismatch, conform, silver_defaults
from adtally.operators.summaries import distinct_counts, partitions_in_use, preview, rows_by
from adtally.operators.validation import rejected
from adtally.plans import gold
from adtally.plans.publish import publish, publish_gold, publish_silver
from adtally.plans.silver import refine
from adtally.session import shared_folder
from adtally.sources.contracts import (
    DIM_MARKET,
    DIM_MERCHANT,
    FACT_CAMPAIGN_DAILY,
    REASON,
    SILVER,
    SOURCE,
    UNKNOWN_PARTITION,
)
from adtally.sources.given import campaign_events
from adtally.sources.quarantine import OtherBatch, read_rejected, write_rejected
from adtally.sources.sinks import (
    balanced,
    declared,
    overwrite_table,
)
from adtally.sources.tables import ensure_schema, qualified, read_table


def fit(df):
    return conform(df, silver_defaults(RUN_TS))


def test_overwrite_replaces_and_counts(spark, lake, events):
    assert overwrite_table(fit(events({}, {"clicks": 1})), lake.silver_events, contract=SILVER).rows == 2
    assert overwrite_table(fit(events({})), lake.silver_events, contract=SILVER).rows == 1
    assert read_table(spark, lake.silver_events).count() == 1


def test_empty_write_counts_nothing(spark, lake, events):
    none = fit(events({})).where("spend < 0")
    assert overwrite_table(none, lake.silver_events, ["market", "date"], SILVER).rows == 0
    back = read_table(spark, lake.silver_events, SILVER)
    assert back.isEmpty() and back.columns == SILVER.names


def test_strict_table_keeps_its_rows_when_the_schema_is_wrong(spark, lake, events):
    overwrite_table(fit(events({})), lake.silver_events, contract=SILVER)
    with pytest.raises(SchemaMismatch):
        overwrite_table(
            fit(events({})).withColumn("extra", F.lit(1)), lake.silver_events, contract=SILVER
        )
    assert read_table(spark, lake.silver_events).columns == SILVER.names


def test_empty_market_survives_as_a_directory(spark, lake, events):
    df = events({"market": None}, {"market": "", "campaign_id": "c2"}, {"campaign_id": "c3"})
    overwrite_table(refine(df, RUN_TS).events, lake.silver_events, ["market", "date"], SILVER)
    back = read_table(spark, lake.silver_events, SILVER)
    assert sorted(r.market for r in back.collect()) == ["DE", UNKNOWN_PARTITION, UNKNOWN_PARTITION]
    with pytest.raises(Exception, match="empty directory value in market"):
        overwrite_table(fit(events({"market": ""})), lake.silver_events, ["market"], SILVER)
    assert read_table(spark, lake.silver_events).count() == 3


def failing(df):
    """``df`` with a column that raises when its rows are computed."""
    name = df.columns[-1]
    bad = F.raise_error(F.lit("planned")).cast(df.schema[name].dataType)
    return df.withColumn(name, F.when(F.lit(True), bad).otherwise(F.col(name)))


@pytest.mark.parametrize("partition_by", [(), ("market",), ("market", "date")])
def test_a_failed_overwrite_leaves_the_table(spark, lake, events, partition_by):
    name = lake.silver_events
    overwrite_table(fit(events({}, {"market": "FR"})), name, partition_by)
    for _ in range(2):
        with pytest.raises(Exception, match="planned"):
            overwrite_table(failing(fit(events({}))), name, partition_by)
        assert read_table(spark, name).count() == 2
    folder = f"{lake.root}/{lake.silver}/campaign_events-versions"
    assert len(glob.glob(f"{folder}/*")) == 1  # nothing is left of the failed ones
    overwrite_table(fit(events({})), name, partition_by)
    assert read_table(spark, name).count() == 1 and len(glob.glob(f"{folder}/*")) == 2
    overwrite_table(fit(events({})), name, partition_by)
    assert len(glob.glob(f"{folder}/*")) == 2  # the current version and the one before
    tables = spark.catalog.listTables(f"spark_catalog.{lake.silver}")
    assert "campaign_events" in {t.name for t in tables} and len(tables) == 3


def test_gold_tables_refuse_another_schema(spark, lake, events):
    overwrite_table(fit(events({})), lake.silver_events, ["market", "date"], SILVER)
    publish_gold(spark, lake, RUN_DATE)
    for table, contract in (
        ("dim_market", DIM_MARKET), ("dim_merchant", DIM_MERCHANT),
        ("fact_campaign_daily", FACT_CAMPAIGN_DAILY),
    ):
        name = lake.gold_table(table)
        before = read_table(spark, name, contract)
        for other in (
            before.withColumn("extra", F.lit(1)),
            before.withColumn(contract.names[0], F.lit("text")),
        ):
            with pytest.raises(SchemaMismatch):
                overwrite_table(declared(other, contract), name, contract=contract)
        missing = before.withColumn(contract.names[0], F.lit(None).cast("bigint"))
        with pytest.raises(Exception, match="null in required column"):
            overwrite_table(declared(missing, contract), name, contract=contract)
        assert spark.table(name).count() == before.count() == 1


def test_the_quarantine_keeps_what_it_has(spark, lake, events):
    path, name = lake.rejected_path, lake.rejected_table
    bad = rejected(events({"spend": None}, {"spend": -1.0}), RUN_TS)
    write_rejected(bad, path, "run-1", table=name)
    later = rejected(events({"spend": None}), RUN_TS.replace(year=2027))
    with pytest.raises(OtherBatch):
        write_rejected(later, path, "run-1", table=name)
    with pytest.raises(SchemaMismatch):
        write_rejected(later.withColumn("spend", F.lit("x")), path, "run-2", table=name)
    assert spark.table(name).count() == read_rejected(spark, path).count() == 2
    write_rejected(later.withColumn("note", F.lit("n")), path, "run-2", table=name)
    write_rejected(bad, path, "run-1", table=name)
    whole = spark.table(name)
    assert whole.count() == 3 and {"note", "run_id"} <= set(whole.columns)
    assert {r.run_id for r in whole.collect()} == {"run-1", "run-2"}


def test_the_quarantine_takes_other_formats(spark, lake, events):
    bad = rejected(events({"spend": None}), RUN_TS)
    write_rejected(bad, lake.rejected_path, "run-1", "orc", lake.rejected_table)
    assert glob.glob(f"{lake.rejected_path}/run_id=run-1/*.orc")
    assert spark.table(lake.rejected_table).count() == 1


def test_frames_and_tables_number_the_same_members(spark, lake, events):
    """Missing and empty markets, and names that sort around the stand-in."""
    rows = [{"market": m, "campaign_id": f"c{i}"} for i, m in enumerate(["a", "Z", None, "", "_"])]
    silver = refine(events(*rows), RUN_TS).events
    star = gold.star(silver, RUN_DATE)
    overwrite_table(silver, lake.silver_events, ["market", "date"], SILVER)
    publish_gold(spark, lake, RUN_DATE)
    for name, frame in star._asdict().items():
        table = spark.table(lake.gold_table(name)).select(*frame.columns)
        assert sorted(map(repr, table.collect())) == sorted(map(repr, frame.collect()))
    assert star.dim_market.count() == 4


def test_number_like_partition_values_stay_text(spark, lake, events):
    overwrite_table(fit(events({"market": "007"})), lake.silver_events, ["market"], SILVER)
    assert read_table(spark, lake.silver_events, SILVER).first().market == "007"


def test_only_wanted_directories_are_opened(spark, lake):
    events = fit(campaign_events(spark, SF_DIR))
    overwrite_table(events, lake.silver_events, ["market", "date"], SILVER)
    wanted = read_table(spark, lake.silver_events, SILVER).where(
        "market = 'click' AND date = DATE '2024-01-10'"
    )
    assert "PartitionFilters: [isnotnull(market" in plan_of(wanted)
    want = events.where("market = 'click' AND date = DATE '2024-01-10'").count()
    assert len(wanted.collect()) == want > 0
    scan = wanted._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1


def test_one_file_per_directory(spark, lake):
    """Rows arrive spread over many tasks and leave in one file per market and day."""
    events = fit(campaign_events(spark, SF_DIR)).repartition(12)
    overwrite_table(events, lake.silver_events, ["market", "date"], SILVER)
    folders = glob.glob(f"{lake.root}/{lake.silver}/campaign_events-versions/*/market=*/date=*")
    files = glob.glob(f"{lake.root}/{lake.silver}/campaign_events-versions/*/market=*/date=*/*.parquet")
    assert len(files) == len(folders) > 100


def test_hot_market_is_written_by_many_tasks(spark, lake, conf):
    """Nine rows in ten are one market's: its files come from several balanced tasks."""
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB")
    rows = spark.range(0, 100_000, 1, 16).select(
        F.when(F.col("id") % 10 == 0, "FR").otherwise("DE").alias("market"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    name = lake.gold_table("hot")
    assert overwrite_table(rows, name, ["market"]).rows == 100_000
    assert len(glob.glob(f"{lake.root}/{lake.gold}/hot-versions/*/market=DE/*.parquet")) > 4
    assert rows_by(spark.table(name), "market").count() == 2
    assert spark.table(name).count() == 100_000


def test_repeated_run_does_not_grow_the_quarantine(spark, events):
    path = f"{shared_folder(spark)}/rejected"
    bad = rejected(events({"spend": None}, {"spend": -1.0}), RUN_TS)
    assert write_rejected(bad, path, "run-1").rows == 2
    assert write_rejected(bad, path, "run-1").rows == 2
    assert read_rejected(spark, path).count() == 2
    assert write_rejected(bad.withColumn("note", F.lit("n")), path, "run-2").rows == 2
    both = read_rejected(spark, path)
    assert both.count() == 4 and {"note", "run_id", REASON} <= set(both.columns)
    assert both.where("note IS NULL").count() == 2
    assert write_rejected(bad.limit(0), path, "run-1").rows == 0
    assert read_rejected(spark, path).count() == 2


def test_run_ids_that_would_change_type_are_refused(spark, events):
    bad = rejected(events({"spend": None}), RUN_TS)
    for run_id in ("007", "2026-01-01", "a/b", ""):
        with pytest.raises(ValueError):
            write_rejected(bad, shared_folder(spark), run_id)


def test_schemas_and_names(spark):
    tag = shared_folder(spark)
    name = "s_" + tag[-12:]
    for _ in range(2):
        ensure_schema(spark, "spark_catalog", name, tag)
    assert spark.catalog.databaseExists(name)
    assert qualified("c", "s", "t") == "`c`.`s`.`t`"


def test_publish_counts_match_the_tables(spark, lake):
    source = campaign_events(spark, SF_DIR)
    counts = publish(source, lake, RUN_TS, RUN_DATE, "run-a")
    tables = {
        "bronze": spark.table(lake.bronze_events),
        "silver": spark.table(lake.silver_events),
        "rejected": read_rejected(spark, lake.rejected_path),
    } | {
        t: spark.table(lake.gold_table(t)) for t in ("dim_merchant", "dim_market", "fact_campaign_daily")
    }
    assert counts == {name: table.count() for name, table in tables.items()}
    assert counts["bronze"] == source.count()
    assert counts["silver"] == counts["fact_campaign_daily"]

    # The same run again changes nothing; a run of its own adds its rejects.
    assert publish(source, lake, RUN_TS, RUN_DATE, "run-a") == counts
    assert read_rejected(spark, lake.rejected_path).count() == counts["rejected"]
    publish_silver(spark, lake, RUN_TS, "run-b")
    assert read_rejected(spark, lake.rejected_path).count() == 2 * counts["rejected"]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_fact_follows_the_layout_of_its_source(spark, lake, limit):
    """One file per market and day either way; a shuffle only if a join scattered the rows."""
    publish(campaign_events(spark, SF_DIR), lake, RUN_TS, RUN_DATE, "run-a")
    publish_gold(spark, lake, RUN_DATE, limit)
    base = f"{lake.root}/{lake.gold}/fact_campaign_daily-versions/*"
    folders = glob.glob(f"{base}/market_key=*/date=*")
    assert len(glob.glob(f"{base}/market_key=*/date=*/*.parquet")) == len(folders) > 100
    assert spark.table(lake.gold_table("fact_campaign_daily")).count() == (
        spark.table(lake.silver_events).count()
    )


def test_check_reports_what_failed(spark, lake, events):
    """A good event without clicks has no ctr."""
    silver = fit(events({}, {"clicks": None, "campaign_id": "c2"}))
    overwrite_table(silver, lake.silver_events, ["market", "date"], SILVER)
    publish_gold(spark, lake, RUN_DATE)
    names = ["--bronze", lake.bronze, "--silver", lake.silver, "--gold", lake.gold]
    common = ["--root", lake.root, *names, "--run-ts", "2026-03-01T06:00:00", "--run-id", "r1"]
    assert run(spark, parse(["check", *common])) == {"not_null fact_campaign_daily.ctr": 1}


def test_summaries(spark, events):
    df = events({}, {"market": "FR", "merchant_id": None}, {"market": "FR"})
    assert dict(map(tuple, rows_by(df, "market").collect())) == {"DE": 1, "FR": 2}
    assert distinct_counts(df, ["market", "merchant_id"]).first() == (2, 1)
    assert [r.market for r in preview(df, SILVER.names, 2).collect()] == ["DE", "FR"]
    assert partitions_in_use(df.repartition(3)).first()[0] == 3
    assert "TakeOrderedAndProject" in plan_of(preview(df, SILVER.names, 2))


def test_layout_is_rebalanced(spark, events):
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(balanced(events({}), "market"))


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session)
    Session.conf = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://ckpt/"})
    assert shared_folder(Session).startswith("hdfs://ckpt/adtally-")
    Session.conf = Conf({"spark.master": "local[2]"})
    assert shared_folder(Session).startswith("/tmp/run-")


def test_job_runs_layer_by_layer(spark, lake, events):
    """The command line: each layer on its own gives what one run of all gives."""
    landed = f"{lake.root}/landing"
    rows = events({}, {"market": "FR"}, {"spend": -1.0}, {"campaign_id": "c2", "market": ""})
    rows.select(*[F.col(f.name).cast(f.dataType) for f in SOURCE]).write.parquet(landed)
    names = ["--bronze", lake.bronze, "--silver", lake.silver, "--gold", lake.gold]
    common = ["--root", lake.root, *names, "--run-ts", "2026-03-01T06:00:00", "--run-id", "r1"]
    at_once = run(spark, parse(["all", "--source", landed, *common]))
    assert at_once == {
        "bronze": 4,
        "silver": 2,
        "rejected": 1,
        "dim_merchant": 1,
        "dim_market": 2,
        "fact_campaign_daily": 2,
    }
    one_by_one = {}
    for layer in ("bronze", "silver", "gold"):
        source = ["--source", landed] if layer == "bronze" else []
        one_by_one |= run(spark, parse([layer, *source, *common]))
    assert one_by_one == at_once
    assert run(spark, parse(["check", *common])) == {}
    by_grain = run(spark, parse(["silver", "--by-grain", "--strict", *common]))
    assert by_grain == {"silver": 2, "rejected": 2}  # the nameless market goes too
    with pytest.raises(SystemExit):
        parse(["bronze", *common])
