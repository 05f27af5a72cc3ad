from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from conftest import RUN_TS, SF_DIR, plan_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from adtally.functions.casting import cast_to
from adtally.operators.dedup import dedup_latest, dedup_stats
from adtally.plans.bronze import ingest
from adtally.plans.silver import refine
from adtally.sources.contracts import EVENT_GRAIN, EVENT_KEY, SILVER, SOURCE
from adtally.sources.given import campaign_events

OLD, NEW = datetime(2026, 1, 2), datetime(2026, 1, 3)


def test_newest_wins(events):
    df = events({"ingestion_ts": OLD, "spend": 9.0}, {"ingestion_ts": NEW, "spend": 1.0})
    assert [r.spend for r in dedup_latest(df).collect()] == [1.0]


def test_missing_time_loses(events):
    df = events({"ingestion_ts": None, "spend": 9.0}, {"ingestion_ts": OLD, "spend": 1.0})
    assert [r.spend for r in dedup_latest(df).collect()] == [1.0]


def test_named_tie_breaker_decides(events):
    df = events({"spend": 9.0, "clicks": 1}, {"spend": 1.0, "clicks": 2})
    assert dedup_latest(df).first().spend == 9.0
    assert dedup_latest(df, tie_breakers=["clicks"]).first().spend == 1.0


def test_two_markets_share_the_default_key(events):
    df = events({"market": "DE"}, {"market": "FR"})
    assert dedup_latest(df).count() == 1
    assert dedup_latest(df, EVENT_GRAIN).count() == 2


def test_null_keys_form_a_group(events):
    df = events({"merchant_id": None}, {"merchant_id": None}, {"merchant_id": "m1"})
    assert dedup_latest(df).count() == 2
    assert dedup_stats(df).first() == (3, 2, 1)


def test_newer_invalid_row_does_not_displace(events):
    df = events({"ingestion_ts": OLD, "spend": 1.0}, {"ingestion_ts": NEW, "spend": None})
    silver = refine(df, RUN_TS)
    assert [r.spend for r in silver.events.collect()] == [1.0]
    assert silver.rejected.count() == 1


def test_rejects_keep_their_copies(events):
    assert refine(events({"spend": None}, {"spend": None}), RUN_TS).rejected.count() == 2


def test_result_does_not_depend_on_layout(spark):
    """A batch with one ingestion time: all ties, in three layouts."""
    batch = ingest(campaign_events(spark, SF_DIR).select(*SOURCE.names), RUN_TS)
    keys = ["merchant_id", "date"]
    expected = sorted(map(tuple, dedup_latest(batch, keys).collect()), key=str)
    for layout in (batch.repartition(1), batch.repartition(7), batch.orderBy("spend").coalesce(3)):
        assert sorted(map(tuple, dedup_latest(layout, keys).collect()), key=str) == expected


def test_one_row_per_key(spark):
    df = cast_to(campaign_events(spark, SF_DIR), SILVER)
    keys = ["merchant_id", "date"]
    kept = dedup_latest(df, keys)
    stats = dedup_stats(df, keys).first()
    assert kept.count() == kept.select(*keys).distinct().count() == stats.key_count
    assert stats.row_count - stats.key_count == stats.duplicates_dropped > 0


def test_stats_of_nothing(events):
    assert dedup_stats(events().limit(0)).first() == (0, 0, 0)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["m1", "m2", None]),
            st.sampled_from(["c1", "c2"]),
            st.integers(0, 2),
            st.one_of(st.none(), st.integers(0, 3)),
            st.one_of(st.none(), st.sampled_from([0.5, 1.5])),
        ),
        max_size=40,
    )
)
def test_against_brute_force(events, rows):
    day = date(2026, 1, 1)
    dicts = [
        {
            "merchant_id": m,
            "campaign_id": c,
            "date": day + timedelta(days=d),
            "clicks": n,
            "spend": s,
        }
        for m, c, d, n, s in rows
    ]

    def rank(row):  # nulls lowest, then by spend, then by clicks
        return tuple((v is not None, v or 0) for v in (row["spend"], row["clicks"]))

    best = {}
    for row in dicts:
        key = tuple(row[k] for k in EVENT_KEY)
        if key not in best or rank(row) > rank(best[key]):
            best[key] = row
    got = dedup_latest(events(*dicts)).select(*EVENT_KEY, "spend", "clicks").collect()
    want = [(*k, r["spend"], r["clicks"]) for k, r in best.items()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_hot_key_is_cut_before_the_shuffle(spark, events):
    """A third of the rows under one key: few of them are shuffled."""
    rng = random.Random(7)
    rows = [
        {"merchant_id": "hot" if i % 3 == 0 else f"m{i}", "spend": rng.random()}
        for i in range(3000)
    ]
    df = events(*rows).repartition(4)
    kept = dedup_latest(df)
    plan = plan_of(kept)
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    best = max(r["spend"] for r in rows if r["merchant_id"] == "hot")
    assert kept.where("merchant_id = 'hot'").first().spend == best
    assert kept.count() == 2001
