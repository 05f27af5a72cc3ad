from __future__ import annotations

import pytest
from conftest import RUN_DATE, RUN_TS, SF_DIR, final_plan_of, plan_of
from pyspark.sql import functions as F

from adtally.functions.metrics import cost_per_click, ctr
from adtally.operators import checks
from adtally.operators.checks import GOLD_CHECKS, Check, null_counts, orphans, run_checks
from adtally.operators.dimensions import build_dim, dense_keys, distinct_members
from adtally.operators.fact import attach_key, broadcast_bytes, build_fact, fits_broadcast
from adtally.plans import gold, sql_models
from adtally.plans.silver import refine
from adtally.sources.sized import Size, written
from adtally.sources.contracts import EVENT_GRAIN
from adtally.sources.given import MISSING_VALUES, campaign_events, shipped_lines


@pytest.mark.parametrize(
    "impressions, clicks, spend, want_ctr, want_cpc",
    [
        (0, 0, 0.0, 0.0, 0.0),
        (10, 3, 1.5, 0.3, 0.5),
        (None, None, None, 0.0, 0.0),
        (10, None, 1.0, None, 0.0),
        (None, 5, 1.0, 0.0, 0.2),
        (10, 2, None, 0.2, None),
        (-5, -1, 1.0, 0.0, 0.0),
    ],
)
def test_ratios(events, impressions, clicks, spend, want_ctr, want_cpc):
    df = events({"impressions": impressions, "clicks": clicks, "spend": spend})
    assert df.select(ctr(), cost_per_click()).first() == (want_ctr, want_cpc)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_keys_are_dense_and_ordered(spark, conf, partitions):
    """Many ranges, no merging: the same keys as one sort over everything."""
    conf(
        spark__sql__shuffle__partitions=str(partitions),
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    members = [f"m{(i * 7919) % 1000}" for i in range(1000)] + [None, "", "ä"]
    df = spark.createDataFrame([(m,) for m in members + members[:500]], "member STRING")
    dim = dense_keys(distinct_members(df, "member"), "member", "key").table.collect()
    want = sorted((m for m in set(members) if m is not None), key=lambda m: m.encode()) + [None]
    assert [r.member for r in sorted(dim, key=lambda r: r.key)] == want
    assert sorted(r.key for r in dim) == list(range(1, len(want) + 1))


def test_keys_without_members(spark):
    empty = spark.createDataFrame([], "member STRING")
    assert dense_keys(empty, "member", "key").table.isEmpty()


def test_members_are_never_sorted_by_one_task(spark):
    """Numbering leaves only one row per range to a single task."""
    members = distinct_members(shipped_lines(spark, SF_DIR), "campaign_id")
    plan = plan_of(dense_keys(members, "campaign_id", "key").table)
    before_single, after_single = plan.split("Exchange SinglePartition")
    assert "HashAggregate" in after_single.splitlines()[1]
    assert "BroadcastHashJoin" in before_single


def test_dimension_columns(spark, events):
    dim = build_dim(events({}, {"market": "FR"}), "market", "market_key", RUN_DATE).table
    assert dim.columns == ["market_key", "market", "effective_date"]
    assert sorted(map(tuple, dim.collect())) == [(1, "DE", RUN_DATE), (2, "FR", RUN_DATE)]


def _silver(spark):
    return refine(campaign_events(spark, SF_DIR, MISSING_VALUES), RUN_TS, keys=EVENT_GRAIN).events


def test_frames_and_sql_agree(spark):
    events = _silver(spark)
    for a, b in zip(gold.star(events, RUN_DATE), sql_models.star(events, RUN_DATE), strict=True):
        assert a.columns == b.columns
        assert [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_fact_keeps_every_event(spark):
    events = _silver(spark)
    assert gold.star(events, RUN_DATE).fact_campaign_daily.count() == events.count()


def joins(fact) -> list[str]:
    """The joins of events to a dimension, not those inside a dimension."""
    lines = [line for line in plan_of(fact).splitlines() if "Join [" in line]
    return [
        line.split("[")[0].split()[-1]
        for line in lines
        if "merchant_id" in line.split("]")[0] or "market" in line.split("]")[0]
    ]


def test_only_dimensions_of_a_measured_size_are_broadcast(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="1")  # Catalyst by itself broadcasts nothing
    events = written(_silver(spark), "events").table
    merchants, markets = gold.merchants(events, RUN_DATE), gold.markets(events, RUN_DATE)
    assert merchants.size.rows == merchants.table.count() > markets.size.rows > 0
    small = build_fact(events, merchants, markets)
    assert joins(small) == ["BroadcastHashJoin", "BroadcastHashJoin"]
    between = (broadcast_bytes(merchants.size) + broadcast_bytes(markets.size)) // 2
    mixed = build_fact(events, merchants, markets, limit=between)
    assert sorted(joins(mixed)) == ["BroadcastHashJoin", "SortMergeJoin"]
    large = build_fact(events, merchants, markets, limit=0)
    assert joins(large) == ["SortMergeJoin", "SortMergeJoin"]
    conf(spark__sql__autoBroadcastJoinThreshold="-1")  # switched off: no hint either
    off = build_fact(events, merchants, markets)
    assert joins(off) == ["SortMergeJoin", "SortMergeJoin"]
    for other in (mixed, large, off):
        assert other.exceptAll(small).isEmpty() and small.exceptAll(other).isEmpty()


def test_the_estimate_is_not_below_the_real_broadcast(spark):
    """A million members: the size of the exchange as Spark reports it."""
    members = spark.range(1_000_000).select(
        F.col("id").alias("merchant_key"), F.format_string("m%07d", "id").alias("merchant_id")
    )
    dim = written(members, "members")
    events = spark.range(10).select(F.format_string("m%07d", "id").alias("merchant_id"))
    joined = attach_key(events, F.broadcast(dim.table), "merchant_id", "merchant_key")
    assert joined.count() == 10
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    sizes, stack = [], [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "BroadcastExchange":
            sizes.append(node.metrics().apply("dataSize").value())
        if node.nodeName().startswith("BroadcastQueryStage"):
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert sizes and max(sizes) <= broadcast_bytes(dim.size) <= 2 * max(sizes)


def test_size_of_a_write(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2), ("ä", None)], "t STRING, n INT")
    sized = written(df, "t")
    assert sized.size == Size(3, 3 * 16 + 2 + 2)
    assert written(df.limit(0), "none").size == Size(0, 0)
    assert fits_broadcast(sized.size) and not fits_broadcast(sized.size, 10)


def test_hot_merchant_is_split_at_the_join(spark, conf):
    """Beyond the broadcast limit, a merchant with a third of the rows is split."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
    )
    rows = spark.range(0, 60_000, 1, 12).select(
        F.expr("IF(id % 3 = 0, 'hot', concat('m', id))").alias("merchant_id"),
        F.lit("DE").alias("market"),
        F.concat(F.lit("c"), "id").alias("campaign_id"),
        F.lit(RUN_DATE).alias("date"),
        F.rand(1).alias("spend"),
        F.lit(10).cast("bigint").alias("impressions"),
        (F.col("id") % 5).alias("clicks"),
    )
    events = written(rows, "events").table
    merchants = gold.merchants(events, RUN_DATE).table
    fact = attach_key(events, merchants, "merchant_id", "merchant_key")
    assert "skew=true" in final_plan_of(fact)
    assert fact.count() == 60_000


def test_checks_count_failures(spark):
    parent = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, None), (3, "b")], "key INT, name STRING"
    )
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "key INT")
    got = run_checks(
        {"parent": parent, "child": child},
        [
            Check("unique", "parent", "key"),
            Check("unique", "parent", "name"),
            Check("not_null", "parent", "name"),
            Check("not_null", "child", "key"),
            Check("relationships", "child", "key", "parent", "key"),
        ],
    )
    assert {(r.check, r.table_name, r.column_name): r.failures for r in got.collect()} == {
        ("unique", "parent", "key"): 1,
        ("unique", "parent", "name"): 1,
        ("not_null", "parent", "name"): 1,
        ("not_null", "child", "key"): 1,
        ("relationships", "child", "key", ): 2,
    }


def test_unknown_check_is_an_error(spark):
    with pytest.raises(ValueError, match="accepted_values"):
        run_checks({"t": spark.range(1)}, [Check("accepted_values", "t", "id")])


def test_gold_passes_its_checks_but_for_null_ratios(spark):
    """Null clicks over positive impressions pass the rules and leave ctr null."""
    tables = gold.star(_silver(spark), RUN_DATE)._asdict()
    failed = run_checks(tables, GOLD_CHECKS).where("failures > 0").collect()
    assert [(r.check, r.column_name) for r in failed] == [("not_null", "ctr")]


def test_null_counts_take_one_pass(spark, events, tmp_path):
    events({}, {"clicks": None}).write.parquet(str(tmp_path / "e"))
    counted = null_counts(spark.read.parquet(str(tmp_path / "e")), ["spend", "clicks"])
    assert plan_of(counted).count("FileScan") == 1
    assert dict(map(tuple, counted.collect())) == {"spend": 0, "clicks": 1}


def test_orphans_of_a_hot_key_are_counted_first(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    hot_third = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    child = spark.range(9000).select(hot_third.alias("k"))
    parent = spark.range(1, 9000).withColumnRenamed("id", "k")
    found = orphans(child, "k", parent, "k")
    assert [tuple(r) for r in found.collect()] == [(0, 3000)]
    plan = plan_of(orphans(child, "k", parent, "k"))
    assert plan.index("LeftAnti") < plan.index("HashAggregate")


def test_checks_read_each_table_once(spark, events, tmp_path):
    """Three tables in files: as many file scans as tables, whatever the number of checks."""
    star = gold.star(refine(events({}, {"market": "FR"}), RUN_TS).events, RUN_DATE)
    tables = {}
    for name, frame in star._asdict().items():
        frame.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    seen = []
    plain = checks.written

    def watched(df, name):
        seen.append(plan_of(df).count("FileScan"))
        return plain(df, name)

    checks.written = watched
    try:
        report = run_checks(tables, GOLD_CHECKS)
    finally:
        checks.written = plain
    assert seen == [1, 1, 1]
    assert not any(str(tmp_path) in line for line in plan_of(report).splitlines())
    assert report.where("failures > 0").isEmpty() and report.count() == len(GOLD_CHECKS)
