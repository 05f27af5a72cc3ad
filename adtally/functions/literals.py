"""Literals Spark types by itself, so that they are known to be non-null."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(value: datetime) -> Column:
    """A timestamp in the session's time zone (or the value's own, if it has one)."""
    return F.expr(f"TIMESTAMP '{value.isoformat(sep=' ')}'")


def micros(value: datetime, zone: str) -> int:
    """Microseconds since 1970 of the same literal, in a session of time zone ``zone``."""
    aware = value if value.tzinfo else value.replace(tzinfo=ZoneInfo(zone))
    return (aware - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
