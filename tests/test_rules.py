from __future__ import annotations

import pytest
from conftest import RUN_TS, SF_DIR, plan_of

from adtally.functions.casting import cast_to
from adtally.functions.rules import DEFAULT_RULES, STRICT_RULES, Rule
from adtally.operators.validation import clean, flag, rejected, rejects_by_reason, split
from adtally.sources.contracts import REASON, SILVER
from adtally.sources.given import STRICT_FAULTS, campaign_events, read_given

NAN = float("nan")


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, ""),
        ({"merchant_id": None}, "missing_merchant_id"),
        ({"campaign_id": None}, "missing_campaign_id"),
        ({"date": None}, "invalid_or_missing_date"),
        ({"spend": None}, "missing_spend"),
        ({"spend": -0.01}, "negative_spend"),
        ({"clicks": 11}, "clicks_exceed_impressions"),
        (
            {"merchant_id": None, "spend": -1.0, "clicks": 5, "impressions": 2},
            "missing_merchant_id,negative_spend,clicks_exceed_impressions",
        ),
        ({"impressions": None, "clicks": 99}, ""),
        ({"clicks": None}, ""),
        ({"spend": 0.0}, ""),
        ({"spend": NAN}, ""),
        ({"clicks": -1}, ""),
        ({"market": None, "ingestion_ts": None}, ""),
    ],
)
def test_default_reasons(events, change, expected):
    assert flag(events(change)).first()[REASON] == expected


@pytest.mark.parametrize(
    "change, expected",
    [
        ({"market": None}, "missing_market"),
        ({"market": ""}, "missing_market"),
        ({"market": "__unknown__"}, "missing_market"),
        ({"ingestion_ts": None}, "missing_ingestion_ts"),
        ({"spend": NAN}, "spend_not_a_number"),
        ({"impressions": -3, "clicks": -4}, "negative_impressions,negative_clicks"),
        ({"impressions": None, "spend": 0.0}, ""),
    ],
)
def test_strict_reasons(events, change, expected):
    assert flag(events(change), STRICT_RULES).first()[REASON] == expected


def test_one_flag_per_rule(events):
    row = flag(events({"spend": None, "date": None})).first()
    flags = {c: row[c] for c in row.asDict() if c.startswith("_fail_")}
    assert list(flags) == [f"_fail_{r.reason}" for r in DEFAULT_RULES]
    assert {c for c, v in flags.items() if v} == {
        "_fail_missing_spend",
        "_fail_invalid_or_missing_date",
    }


def test_halves_make_the_whole(spark):
    """Every row is in exactly one half, with its values untouched."""
    df = cast_to(campaign_events(spark, SF_DIR, STRICT_FAULTS), SILVER)
    for rules in (DEFAULT_RULES, STRICT_RULES):
        good, bad = split(df, RUN_TS, rules)
        whole = good.unionAll(bad.select(df.columns))
        assert whole.exceptAll(df).isEmpty() and df.exceptAll(whole).isEmpty()
        assert good.count() and bad.count()


def test_filter_agrees_with_reason(spark):
    """The boolean split and the text of the reason decide alike."""
    df = cast_to(campaign_events(spark, SF_DIR, STRICT_FAULTS), SILVER)
    flagged = flag(df, STRICT_RULES)
    assert clean(df, STRICT_RULES).count() == flagged.where(f"{REASON} = ''").count()
    by_text = flagged.where(f"{REASON} <> ''").groupBy(REASON).count()
    counted = rejects_by_reason(rejected(df, RUN_TS, STRICT_RULES))
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, counted.collect()))


def test_rejects_carry_time_and_reason(events):
    row = rejected(events({"spend": -1.0}), RUN_TS).first()
    assert row[REASON] == "negative_spend" and row["_quarantined_at"] == RUN_TS


def test_empty_input(events):
    good, bad = split(events().limit(0), RUN_TS)
    assert good.columns == SILVER.names and good.isEmpty()
    assert bad.columns == [*SILVER.names, REASON, "_quarantined_at"] and bad.isEmpty()


def test_null_checks_reach_the_reader(spark, events, tmp_path):
    events({}).write.parquet(str(tmp_path / "e"))
    plan = plan_of(clean(spark.read.parquet(str(tmp_path / "e"))))
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    for column in ("merchant_id", "campaign_id", "date", "spend"):
        assert f"IsNotNull({column})" in pushed
    assert "Exchange" not in plan


def test_rejects_skip_row_groups_without_any(spark):
    overdrawn = rejected(
        read_given(spark, SF_DIR, "customer"), RUN_TS, [Rule("overdrawn", "c_acctbal < 0")]
    )
    assert "LessThan(c_acctbal,0.0)" in plan_of(overdrawn)


def test_no_rules_reject_nothing(events):
    good, bad = split(events({"spend": None}), RUN_TS, [])
    assert good.count() == 1 and bad.isEmpty()


def test_rules_on_any_table(spark):
    df = spark.createDataFrame([(1, 5), (2, -5), (3, None)], "id INT, balance INT")
    bad = rejected(df, RUN_TS, [Rule("overdrawn", "balance < 0")])
    assert [r.id for r in bad.collect()] == [2]


def test_unreadable_values_become_null(spark):
    raw = spark.createDataFrame(
        [("m", "c", "DE", "2026-13-45", "abc", "x1", "99999999999999999999", "never")],
        ", ".join(f"{c} STRING" for c in SILVER.names),
    )
    row = cast_to(raw, SILVER).first()
    assert row[3:] == (None,) * 5
    assert flag(cast_to(raw, SILVER)).first()[REASON] == "invalid_or_missing_date,missing_spend"


def test_readable_values_keep_their_type(spark):
    raw = spark.createDataFrame(
        [("m", "c", "DE", "2026-01-31", "1.5", "7", "3", "2026-01-31 10:00:00")],
        ", ".join(f"{c} STRING" for c in SILVER.names),
    )
    typed = cast_to(raw, SILVER)
    assert [f.dataType for f in typed.schema] == [f.dataType for f in SILVER]
    assert None not in typed.first()
