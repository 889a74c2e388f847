"""Calendar features known in advance for any period.

All of them are derived from epoch arithmetic or a DATE, so the session time
zone plays no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_PI = 2.0 * math.pi


def hour_of_day(ts: Column) -> Column:
    return F.pmod(F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def epoch_day(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000)).cast("int")


def day_of_week(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.pmod(epoch_day(ts) + F.lit(3), F.lit(7)).cast("int")


def iso_week(ts: Column) -> Column:
    return F.weekofyear(F.date_from_unix_date(epoch_day(ts))).cast("int")


def cyclical(value: Column, period: float, prefix: str) -> list[Column]:
    angle = F.lit(TWO_PI) * value.cast("double") / F.lit(float(period))
    return [F.sin(angle).alias(f"Sin_{prefix}"), F.cos(angle).alias(f"Cos_{prefix}")]


def calendar_columns(ts: Column, gran: str, with_raw: bool = False) -> list[Column]:
    """Sin/Cos of day-of-week (/7), ISO week (/52, also in week 53) and, for
    hourly data, hour of day (/24)."""
    cols: list[Column] = []
    if gran.upper() == "H":
        h = hour_of_day(ts)
        if with_raw:
            cols.append(h.alias("Hour"))
        cols += cyclical(h, 24, "Hour")
    dow = day_of_week(ts)
    if with_raw:
        cols.append(dow.alias("DayOfWeek"))
    cols += cyclical(dow, 7, "DayOfWeek")
    woy = iso_week(ts)
    if with_raw:
        cols.append(woy.cast("double").alias("WeekOfYear"))
    cols += cyclical(woy, 52, "WeekOfYear")
    return cols


def entity_key(ts: Column, gran: str) -> Column:
    """Feature-store entity key: 'yyyy-MM-dd' for daily rows, 'yyyy-MM-ddTHH' otherwise (C4)."""
    naive = ts.cast("timestamp_ntz")
    fmt = "yyyy-MM-dd" if gran.upper() == "D" else "yyyy-MM-dd'T'HH"
    return F.date_format(naive, fmt)
