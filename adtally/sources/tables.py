"""Scans, catalog names, and the required-column check of the source contract."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, StructType, TimestampType

from adtally.functions.literals import timestamp
from adtally.sources.contracts import SOURCE, UNKNOWN_DATE, UNKNOWN_TEXT


def qualified(catalog: str, schema: str, table: str) -> str:
    """A quoted three-level table name."""
    return ".".join(f"`{part}`" for part in (catalog, schema, table))


def ensure_schema(
    spark: SparkSession, catalog: str, schema: str, location: str | None = None
) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{catalog}`.`{schema}`{where}")


def read_table(spark: SparkSession, name: str, schema: StructType | None = None) -> DataFrame:
    """A catalog table; with ``schema``, its columns in the contract's order."""
    table = spark.table(name)
    return table.select(*schema.names) if schema else table


def typed_scan(
    spark: SparkSession, path: str, schema: StructType = SOURCE, fmt: str = "parquet"
) -> DataFrame:
    """Files under an explicit contract: no inference, and a null in a required column fails."""
    return require_values(spark.read.schema(schema).format(fmt).load(path), schema)


def _never(data_type: DataType) -> Column:
    """A literal that marks a checked column non-null; it is never returned."""
    if isinstance(data_type, StringType):
        return F.lit(UNKNOWN_TEXT)
    if isinstance(data_type, DateType):
        return F.lit(UNKNOWN_DATE)
    if isinstance(data_type, TimestampType):
        return timestamp(datetime(1970, 1, 1))
    return F.lit(0)


def require_values(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``; reading a null from a required one raises.

    Files do not keep non-null flags, so the check runs inside the scan's projection, at
    no extra pass, and restores the flag.
    """

    def checked(field) -> Column:
        if field.nullable:
            return F.col(field.name)
        failure = F.raise_error(F.lit(f"null in required column {field.name}"))
        return F.coalesce(
            F.col(field.name), failure.cast(field.dataType), _never(field.dataType)
        ).alias(field.name)

    return df.select(*[checked(f) for f in schema.fields])
