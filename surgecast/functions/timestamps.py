"""Timestamp expressions.

Periods are computed from epoch microseconds, so bucketing never depends on the
session time zone: an hour or a day is always the UTC hour or day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from ..config import TS_CANDIDATES, granularity


def resolve_ts_column(df: DataFrame, candidates=TS_CANDIDATES) -> str:
    """Pick the event-time column by priority list, else the first column (F1)."""
    for name in candidates:
        if name in df.columns:
            return name
    return df.columns[0]


def coerce_timestamp(df: DataFrame, col: str) -> Column:
    """Parse with coercion: unparseable values become null instead of failing (F2)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.col(col)
    if isinstance(dtype, StringType):
        return F.try_to_timestamp(F.col(col))
    return F.expr(f"try_cast(`{col}` AS TIMESTAMP)")


def to_utc(col: Column, source_tz: str | None = None) -> Column:
    """Normalise to a UTC instant.

    Naive values are UTC wall time unless ``source_tz`` names their zone, in
    which case they are converted from that zone. Requires session TZ = UTC.
    """
    ts = col.cast("timestamp")
    if source_tz:
        ts = F.to_utc_timestamp(ts, source_tz)
    return ts


def period_index(ts: Column, gran: str) -> Column:
    """Absolute period number: consecutive periods differ by exactly one."""
    g = granularity(gran)
    return F.floor((F.unix_micros(ts.cast("timestamp")) + F.lit(g.offset_us)) / F.lit(g.step_us)).cast("long")


def period_from_index(idx: Column, gran: str) -> Column:
    g = granularity(gran)
    return F.timestamp_micros(idx * F.lit(g.step_us) - F.lit(g.offset_us))


def period_start(ts: Column, gran: str) -> Column:
    """Start of the UTC period containing ``ts`` (TIMESTAMP)."""
    return period_from_index(period_index(ts, gran), gran)


def as_naive(col: Column) -> Column:
    """UTC instant -> naive UTC wall time, the type the oracle engine reports."""
    return col.cast("timestamp_ntz")
