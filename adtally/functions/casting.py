"""Casts that turn what cannot be read into null, also with ANSI mode on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lenient_columns(schema: StructType) -> list[Column]:
    """Every column of ``schema``, cast to its declared type or null."""
    return [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]


def cast_to(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order; one projection, no shuffle."""
    return df.select(*lenient_columns(schema))
