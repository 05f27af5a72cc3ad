"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import glob
import os
from datetime import datetime

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> pd.Series:
    """Sorted text rows, columns by name, with the kind of each value spelled out."""
    frame = frame[sorted(frame.columns)]

    def text(value) -> str:
        if value is None or value is pd.NaT:
            return "NULL"
        if isinstance(value, float):
            return repr(value)
        if isinstance(value, datetime):
            return value.isoformat().removesuffix("T00:00:00")
        return str(value)

    lines = ["|".join(map(text, r)) for r in frame.itertuples(index=False)]
    return pd.Series(sorted(lines))


def arrow_rows(table) -> pd.Series:
    """By way of Python values: a frame of floats would not tell null from NaN."""
    columns = {name: pd.Series(table[name].to_pylist(), dtype=object) for name in table.column_names}
    return rows(pd.DataFrame(columns))


def differences(spark_df, con, sql: str) -> str | None:
    """None if schema names, types of values, row count and rows agree."""
    got, want = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    for name in got.column_names:
        a, b = (t.schema.field(name).type for t in (got, want))
        same = str(a).split("[")[0].removeprefix("large_") == str(b).split("[")[0]
        if not same:
            return f"type of {name}: {a} != {b}"
    a, b = arrow_rows(got), arrow_rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    unequal = a != b
    if unequal.any():
        return f"{unequal.sum()} rows differ, e.g. {a[unequal].iloc[0]} != {b[unequal].iloc[0]}"
    return None
