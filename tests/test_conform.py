from __future__ import annotations

from datetime import date

import pytest
from conftest import EVENT_TEXT, RUN_TS
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adtally.__main__ import clock
from adtally.functions.literals import timestamp
from adtally.operators.conform import (
    SchemaMismatch,
    conform,
    fill_required,
    require_schema,
    silver_defaults,
)
from adtally.plans.bronze import ingest
from adtally.sources.contracts import BRONZE, SILVER, SOURCE
from adtally.sources.tables import require_values, typed_scan


def test_fills_and_marks_required_columns(events):
    holes = dict.fromkeys(["merchant_id", "campaign_id", "market", "date", "ingestion_ts"])
    fitted = conform(events(holes), silver_defaults(RUN_TS))
    assert fitted.schema == SILVER
    row = fitted.first()
    assert row[:4] == ("", "", "", date(1970, 1, 1)) and row.ingestion_ts == RUN_TS


def test_reorders_drops_and_widens(events):
    narrow = events({}).withColumn("clicks", F.col("clicks").cast("int")).withColumn("x", F.lit(1))
    fitted = conform(narrow.select(*reversed(narrow.columns)), silver_defaults(RUN_TS))
    assert fitted.schema == SILVER and fitted.first().clicks == 2


def test_measures_stay_null(events):
    row = conform(events({"spend": None, "clicks": None}), silver_defaults(RUN_TS)).first()
    assert row.spend is None and row.clicks is None


def test_unfit_type_or_missing_column_is_an_error(events):
    defaults = silver_defaults(RUN_TS)
    with pytest.raises(AnalysisException):
        conform(events({}).withColumn("spend", F.lit("12")), defaults)
    with pytest.raises(AnalysisException):
        conform(events({}).drop("market"), {k: v for k, v in defaults.items() if k != "market"})
    with pytest.raises(AnalysisException):
        events({}).to(SILVER)


def test_schema_gate(events):
    fitted = conform(events({}), silver_defaults(RUN_TS))
    assert require_schema(fitted, SILVER) is fitted
    for wrong in (
        fitted.withColumn("extra", F.lit(1)),
        fitted.withColumn("spend", F.col("spend").cast("string")),
        events({}),
        fitted.select(*reversed(fitted.columns)),
        fitted.drop("clicks"),
    ):
        with pytest.raises(SchemaMismatch):
            require_schema(wrong, SILVER)


def test_default_literals_are_not_nullable(events):
    filled = fill_required(events({}), silver_defaults(RUN_TS))
    assert not any(filled.schema[c].nullable for c in silver_defaults(RUN_TS))


def test_typed_scan_restores_the_contract(spark, events, tmp_path):
    path = str(tmp_path / "landing")
    events({}, {"clicks": None}).select(
        *[F.col(f.name).cast(f.dataType) for f in SOURCE]
    ).write.parquet(path)
    assert typed_scan(spark, path).schema == SOURCE
    assert typed_scan(spark, path).count() == 2


@pytest.mark.parametrize("column", ["merchant_id", "campaign_id", "market", "date"])
def test_null_in_a_required_column_fails(events, column):
    with pytest.raises(PySparkException, match=f"required column {column}"):
        require_values(events({}, {column: None}), SOURCE).collect()


def test_ingest_stamps_the_batch_once(events):
    sent = events({}).select(*[F.col(f.name).cast(f.dataType) for f in SOURCE])
    stamped = ingest(sent, RUN_TS)
    assert stamped.schema == BRONZE and stamped.first().ingestion_ts == RUN_TS
    later = RUN_TS.replace(year=2030)
    assert ingest(stamped, later).first().ingestion_ts == later
    kept = ingest(stamped, later, keep_stamp=True)
    assert kept.schema == BRONZE and kept.first().ingestion_ts == RUN_TS


def test_ingest_keeps_the_columns_of_its_contract(events):
    wide = StructType([*SOURCE.fields, StructField("channel", StringType())])
    sent = events({}).select(*[F.col(f.name).cast(f.dataType) for f in SOURCE])
    sent = sent.withColumns({"channel": F.lit("web"), "other": F.lit(1)})
    for df in (sent, sent.withColumn("ingestion_ts", F.lit(None).cast("timestamp"))):
        assert ingest(df, RUN_TS, wide).columns == [*wide.names, "ingestion_ts"]
        assert ingest(df, RUN_TS, wide).first().ingestion_ts == RUN_TS


def test_the_job_s_clock_has_a_zone(spark, conf):
    moments = set()
    for zone in ("UTC", "America/New_York"):
        conf(spark__sql__session__timeZone=zone)
        row = spark.range(1).select(timestamp(clock("2024-02-01T06:00:00")).cast("long"))
        moments.add(row.first()[0])
    assert moments == {1706767200}
    assert clock("2024-02-01T06:00:00+02:00").utcoffset().total_seconds() == 7200


def test_columns_of_the_contract(events):
    assert [f.strip().split()[0] for f in EVENT_TEXT.split(",")] == SILVER.names
