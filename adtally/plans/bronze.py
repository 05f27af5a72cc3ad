"""Bronze: typed events, stamped at the lake boundary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from adtally.functions.literals import timestamp
from adtally.sources.contracts import INGESTED_AT, SOURCE
from adtally.sources.tables import require_values


def ingest(
    df: DataFrame,
    run_ts: datetime,
    contract: StructType = SOURCE,
    keep_stamp: bool = False,
) -> DataFrame:
    """The contract's columns, required ones checked, under the batch's stamp.

    The stamp is a parameter, so a repeated run gives the same rows. A stamp that was sent
    is overwritten: a wrong one would win every later dedup. ``keep_stamp`` is for batches
    that this lake stamped when they first arrived.
    """
    if keep_stamp:
        return require_values(df, StructType([*contract.fields, INGESTED_AT]))
    return require_values(df, contract).withColumn(INGESTED_AT.name, timestamp(run_ts))
