"""Late batches, stable keys, dimension history and joins to it."""

from __future__ import annotations

import glob
from datetime import date, datetime, timedelta

import pytest
from conftest import RUN_DATE, RUN_TS, SF_DIR, plan_of
from pyspark.sql import functions as F

from adtally.__main__ import parse, run
from adtally.operators import history
from adtally.operators.dimensions import extend_dim
from adtally.plans import gold
from adtally.plans.merge import LAYOUT, merge_silver
from adtally.plans.publish import publish_gold
from adtally.plans.silver import refine
from adtally.sources import versions
from adtally.sources.contracts import EVENT_GRAIN, SOURCE, UNKNOWN_PARTITION
from adtally.sources.given import MISSING_VALUES, campaign_events
from adtally.sources.quarantine import OtherBatch, read_rejected
from adtally.sources.sized import Size, Sized
from adtally.sources.tables import read_table

LATER = RUN_TS + timedelta(days=1)


def rows_of(spark, lake):
    return sorted(map(repr, read_table(spark, lake.silver_events).collect()))


def files_of(spark, lake):
    version = versions.current_version(spark, lake.silver_events)
    places = versions.directories(spark, version, LAYOUT)
    return {n: sorted(glob.glob(f"{p.removeprefix('file:')}/*.parquet")) for n, p in places.items()}


# --- Merge ----------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [None, EVENT_GRAIN])
def test_batches_equal_one_rebuild(spark, lake, keys):
    """Six batches in any order; a third of them arrives twice."""
    more = {"keys": keys} if keys else {}
    source = campaign_events(spark, SF_DIR, MISSING_VALUES).where("ingestion_ts IS NOT NULL")
    part = F.pmod(F.xxhash64("merchant_id", "date", "spend"), F.lit(4))
    for k, number in enumerate([3, 0, 2, 1, 0, 3]):
        merge_silver(source.where(part == number), lake, RUN_TS, f"run-{k}", **more)
    whole = refine(source, RUN_TS, **more).events
    assert rows_of(spark, lake) == sorted(
        map(repr, whole.select(*read_table(spark, lake.silver_events).columns).collect())
    )


def test_only_touched_directories_change(spark, lake, events):
    days = [date(2026, 1, d) for d in range(1, 5)]
    first = [
        {"market": m, "date": d, "campaign_id": f"{m}{d}"} for m in ("DE", "FR") for d in days
    ]
    merge_silver(events(*first), lake, RUN_TS, "run-1")
    before = files_of(spark, lake)
    stamp = datetime(2026, 2, 1)
    late = [
        {"market": "DE", "date": days[0], "campaign_id": f"DE{days[0]}", "spend": 9.0, "ingestion_ts": stamp},
        # The key of a French row, now in a market of its own:
        {"market": "PL", "date": days[1], "campaign_id": f"FR{days[1]}", "ingestion_ts": stamp},
        # An old version of a key: it loses.
        {"market": "DE", "date": days[2], "campaign_id": f"DE{days[2]}", "spend": 7.0,
         "ingestion_ts": datetime(2025, 1, 1)},
        {"market": "DE", "date": days[3], "spend": -1.0},
    ]
    merged = merge_silver(events(*late), lake, LATER, "run-2")
    assert merged.touched == {("DE", days[0]), ("FR", days[1]), ("PL", days[1]), ("DE", days[2])}
    assert merged.rejected == 1 and merged.rows == 3
    after = files_of(spark, lake)
    assert set(after) == set(before) - {"market=FR/date=2026-01-02"} | {"market=PL/date=2026-01-02"}
    kept = set(before) - {f"market={m}/date={d}" for m, d in merged.touched}
    assert len(kept) == 5 and all(after[n] == before[n] for n in kept)
    spend = {r.campaign_id: r.spend for r in read_table(spark, lake.silver_events).collect()}
    assert len(spend) == 8
    assert spend[f"DE{days[0]}"] == 9.0 and spend[f"DE{days[2]}"] == 1.0


def test_merging_again_changes_nothing(spark, lake, events):
    batch = events({"market": None}, {"market": "", "campaign_id": "c2"}, {"campaign_id": "c3"})
    merge_silver(batch, lake, RUN_TS, "run-1")
    once = rows_of(spark, lake)
    assert merge_silver(batch, lake, RUN_TS, "run-1").rows == 3
    assert rows_of(spark, lake) == once and len(once) == 3
    assert sum(UNKNOWN_PARTITION in r for r in once) == 2
    # A named market beats the stand-in of a missing one, as in one rebuild.
    merge_silver(events({"market": "DE"}), lake, RUN_TS, "run-2")
    assert sum(UNKNOWN_PARTITION in r for r in rows_of(spark, lake)) == 1


def test_an_empty_batch_keeps_the_table(spark, lake, events):
    none = events({}).where("spend < 0")
    assert merge_silver(none, lake, RUN_TS, "run-0") == (0, 0, frozenset())
    merge_silver(events({}), lake, RUN_TS, "run-1")
    before = files_of(spark, lake)
    assert merge_silver(none, lake, RUN_TS, "run-2").rows == 0
    assert files_of(spark, lake) == before
    with pytest.raises(OtherBatch):
        merge_silver(none, lake, LATER, "run-2")


def test_old_directories_are_not_read(spark, lake):
    """The search for equal keys opens the batch's days alone."""
    source = campaign_events(spark, SF_DIR)
    merge_silver(source, lake, RUN_TS, "run-1")
    silver = read_table(spark, lake.silver_events)
    one_day = silver.where(F.col("date").isin([date(2024, 1, 10)]))
    assert len(one_day.inputFiles()) >= 1
    one_day.collect()
    scan = one_day._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() <= 5


def test_merge_is_a_step_of_the_job(spark, lake, events):
    landed = [f"{lake.root}/landing-{k}" for k in range(2)]
    batches = events({}, {"spend": -1.0}), events({"spend": 5.0}, {"campaign_id": "c2"})
    for path, rows in zip(landed, batches):
        rows.select(*[F.col(f.name).cast(f.dataType) for f in SOURCE]).write.parquet(path)
    names = ["--bronze", lake.bronze, "--silver", lake.silver, "--gold", lake.gold]
    for k, at in enumerate(("2026-03-01T06:00:00", "2026-03-02T06:00:00")):
        common = ["--root", lake.root, *names, "--run-ts", at, "--run-id", f"r{k}"]
        run(spark, parse(["merge", "--source", landed[k], *common]))
        run(spark, parse(["gold", "--stable-keys", *common]))
    assert {r.spend for r in read_table(spark, lake.silver_events).collect()} == {5.0, 1.0}
    assert read_rejected(spark, lake.rejected_path).count() == 1
    assert spark.table(lake.gold_table("fact_campaign_daily")).count() == 2
    with pytest.raises(SystemExit):
        parse(["merge", *common])


# --- Stable keys ----------------------------------------------------------------------


def test_members_keep_their_keys(spark, lake, events):
    def merchants():
        return {r.merchant_id: (r.merchant_key, r.effective_date)
                for r in spark.table(lake.gold_table("dim_merchant")).collect()}

    merge_silver(events({"merchant_id": "m5"}, {"merchant_id": "m2"}), lake, RUN_TS, "r1")
    publish_gold(spark, lake, RUN_DATE, stable_keys=True)
    assert merchants() == {"m2": (1, RUN_DATE), "m5": (2, RUN_DATE)}
    later = RUN_DATE + timedelta(days=1)
    merge_silver(events(*({"merchant_id": m} for m in ("m1", "m9", "m5"))), lake, LATER, "r2")
    for _ in range(2):
        publish_gold(spark, lake, later, stable_keys=True)
        assert merchants() == {
            "m2": (1, RUN_DATE), "m5": (2, RUN_DATE), "m1": (3, later), "m9": (4, later)
        }
    fact = spark.table(lake.gold_table("fact_campaign_daily"))
    assert sorted(r.merchant_key for r in fact.collect()) == [1, 2, 3, 4]
    publish_gold(spark, lake, later)  # by default, keys are numbered anew
    assert {m: k for m, (k, _) in merchants().items()} == {"m1": 1, "m2": 2, "m5": 3, "m9": 4}


def test_a_null_member_and_gone_ones_stay(spark, events):
    first = events({"merchant_id": None}, {"merchant_id": "b"}, {"merchant_id": "c"})
    known = gold.merchants(first, RUN_DATE)
    second = events({"merchant_id": None}, {"merchant_id": "a"})
    grown = extend_dim(known, second, "merchant_id", "merchant_key", RUN_DATE)
    keys = {r.merchant_id: r.merchant_key for r in grown.table.collect()}
    assert keys == {"b": 1, "c": 2, None: 3, "a": 4} and grown.size.rows == 4
    empty = Sized(known.table.limit(0), Size(0, 0))
    assert extend_dim(empty, second, "merchant_id", "merchant_key", RUN_DATE).table.count() == 2


# --- History --------------------------------------------------------------------------

DAY = [date(2026, 1, 1) + timedelta(days=10 * k) for k in range(6)]


def through(spark, *states):
    """The history after states of ``{member: attribute}``, one per day."""
    found = None
    for day, members in zip(DAY, states):
        now = spark.createDataFrame(list(members.items()), "id STRING, kind STRING")
        if found is None:
            found = history.first_history(now, "id", ["kind"], day)
        else:
            found = history.next_history(found, now, "id", ["kind"], day)
    return found


def test_versions_begin_and_end(spark):
    states = [
        {"a": "x", "b": "x", "c": None}, {"a": "x", "b": "y", "c": None, "d": "z"},
        {"a": "x", "c": "x"}, {"a": "x", "b": "y", "c": "x", "d": "z"},
    ]
    found = through(spark, *states)
    rows = sorted(tuple(r) for r in found.select("id", "valid_from", "valid_to", "kind").collect())
    assert rows == sorted([
        ("a", DAY[0], None, "x"), ("b", DAY[0], DAY[1], "x"), ("b", DAY[1], DAY[2], "y"),
        ("b", DAY[3], None, "y"), ("c", DAY[0], DAY[2], None), ("c", DAY[2], None, "x"),
        ("d", DAY[1], DAY[2], "z"), ("d", DAY[3], None, "z"),
    ])
    assert history.overlaps(found, "id").count() == 0
    assert history.overlaps(found.unionAll(found), "id").count() == 4
    for k, members in enumerate(states):  # each state can be read back
        at = F.lit(DAY[k])
        now = found.where((F.col("valid_from") <= at) & F.coalesce(at < F.col("valid_to"), F.lit(True)))
        assert {r.id: r.kind for r in now.collect()} == members


def test_a_state_can_be_repeated_but_not_put_in_before(spark):
    found = through(spark, {"a": "x", "b": "x"}, {"a": "y"})
    again = spark.createDataFrame([("a", "z"), ("c", "x")], "id STRING, kind STRING")
    twice = history.next_history(found, again, "id", ["kind"], DAY[1])
    rows = sorted(tuple(r) for r in twice.select("id", "valid_from", "valid_to", "kind").collect())
    assert rows == [
        ("a", DAY[0], DAY[1], "x"), ("a", DAY[1], None, "z"), ("b", DAY[0], DAY[1], "x"),
        ("c", DAY[1], None, "x"),
    ]
    with pytest.raises(Exception, match="a version begins after"):
        history.next_history(found, again, "id", ["kind"], DAY[0]).collect()


def test_states_take_the_newest_event(spark, events):
    rows = events(
        {"market": "DE"}, {"market": "FR", "ingestion_ts": datetime(2026, 2, 1)},
        {"market": "AA", "ingestion_ts": datetime(2026, 2, 1)}, {"merchant_id": None},
    )
    found = history.state(rows, "merchant_id", ["market"], ["ingestion_ts"])
    assert {r.merchant_id: r.market for r in found.collect()} == {"m1": "FR", None: "DE"}


@pytest.mark.parametrize("limit", [-1, 1 << 20])
@pytest.mark.parametrize("bucket_days", [1, 7, 400])
def test_events_meet_the_version_of_their_day(spark, events, limit, bucket_days):
    found = through(spark, {"m1": "x", "m2": "x"}, {"m1": "y"}, {"m1": "z", "m2": "z"})
    days = [DAY[0] + timedelta(days=d) for d in range(-3, 40)]
    rows = events(
        *({"merchant_id": m, "date": d} for m in ("m1", "m2", "m3") for d in days),
        {"merchant_id": "m1", "date": None}, {"merchant_id": None},
    )
    versions_of = found.withColumnRenamed("id", "merchant_id")
    out = history.attach_valid(
        rows, versions_of, "merchant_id", ["kind"], bucket_days=bucket_days, limit=limit
    )
    plan = plan_of(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    kinds = {(r.merchant_id, r.date): r.kind for r in out.collect()}
    assert out.count() == 3 * len(days) + 2

    def want(m, d):
        k = (d - DAY[0]).days // 10
        states = [{"m1": "x", "m2": "x"}, {"m1": "y"}, {"m1": "z", "m2": "z"}]
        return states[min(k, 2)].get(m) if k >= 0 else None

    assert kinds == {(m, d): want(m, d) for m in ("m1", "m2", "m3") for d in days} | {
        ("m1", None): None, (None, date(2026, 1, 1)): None
    }
    assert history.attach_valid(rows.limit(0), versions_of, "merchant_id", ["kind"]).count() == 0
