from __future__ import annotations

import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def documents(spark):
    """Rows of documents from (doc_id, text) pairs, or from whole rows."""

    def make(*rows):
        full = [
            r if len(r) == 5 else (r[0], r[1], "en", "src0", len(r[1] or "")) for r in rows
        ]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def saved(spark, tmp_path):
    """A folder of tables for a query, from frames by name."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
