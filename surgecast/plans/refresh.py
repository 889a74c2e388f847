"""Interval-wise rebuild of counts and features (P5).

When raw events of some stretch of time come late or are corrected, only what depends
on that stretch is made anew: its counts, and the feature rows whose lags, rolling
windows or exponential averages reach back into it. Both tables are partitioned by
month, and only the months that hold such rows are replaced; the result equals a full
rebuild.

An exponential average remembers everything, but with weights that fall below half a
unit in the last place of a double after a known number of periods (``memory``): beyond
it nothing changes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import granularity
from ..functions.timestamps import period_from_index, period_index
from ..operators import features as feat, ingest
from ..operators.common import join_on
from ..operators.windows import IDX
from ..session import written
from ..sources import sinks


def lookback(gran: str) -> int:
    """Periods that lags and rolling windows reach back."""
    g = granularity(gran)
    return max([*g.lags, *(n - 1 for n in g.rolling)])


def memory(gran: str) -> int:
    """Periods after which a value has left every feature of a double's precision."""
    slowest = max(granularity(gran).ema_spans)
    return max(lookback(gran), math.ceil(60 * math.log(2) / -math.log(1 - 2 / (slowest + 1))))


@dataclass(frozen=True)
class Rebuilt:
    """Months of either table that were replaced."""

    counts: list[str]
    features: list[str]


def _month(idx: Column, gran: str) -> Column:
    return F.date_format(period_from_index(idx, gran).cast("timestamp_ntz"), "yyyy-MM")


def _replace_months(spark: SparkSession, rows: DataFrame, path: str, months: list[str]) -> None:
    """Write ``rows`` as the whole content of ``months`` of a table."""
    staged = written(rows, "months")
    left = {r[0] for r in staged.select("month").distinct().collect()}  # of the months asked for
    if left:
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    for m in set(months) - left:
        sinks.remove_path(spark, f"{path}/month={m}")


def _months(spark: SparkSession, low: int, high: int, gran: str) -> list[str]:
    """Months of the periods ``low`` to ``high`` (one a period at most is looked at)."""
    return [r[0] for r in spark.range(low, high + 1).select(_month(F.col("id"), gran).alias("m")).distinct().orderBy("m").collect()]


def _extent(counts: DataFrame | None, series_cols) -> DataFrame | None:
    return None if counts is None else counts.groupBy(*series_cols).agg(F.min(IDX).alias("_lo"), F.max(IDX).alias("_hi"))


def refresh(spark: SparkSession, raw: DataFrame, root: str, gran: str, ts_col: str, series_cols=(), *, as_of, start=None, end=None) -> Rebuilt:
    """Bring ``root`` (its ``counts`` and ``features`` tables) up to the raw events.

    Without ``start`` and ``end`` everything is built. With them, ``raw`` has changed in
    ``[start, end)`` at most, and of the raw table only this stretch is read. A series
    that begins or ends elsewhere because of the change is followed up to there."""
    keys = list(series_cols)
    counts_path, features_path = f"{root}/counts", f"{root}/features"
    bounds = {}
    if start is not None:  # whole periods, so that a count is either kept or made anew
        edge = lambda t, up: spark.range(1).select(
            (F.ceil if up else F.floor)((F.unix_micros(F.lit(str(t)).cast("timestamp")) + granularity(gran).offset_us) / granularity(gran).step_us).cast("long")).first()[0]
        first, last = edge(start, False), edge(end, True) - 1
        stamps = spark.range(1).select(period_from_index(F.lit(first), gran).cast("string"), (period_from_index(F.lit(last + 1), gran) - F.expr("INTERVAL 1 MICROSECOND"))
                                       .cast("string")).first()
        bounds = {"min_ts": stamps[0], "as_of": min(stamps[1], str(as_of))}
    fresh = ingest.count_per_period(ingest.clean_events(raw, ts_col, keep=keys, **({"as_of": as_of} | bounds)), ts_col, gran, keys)
    fresh = written(fresh.select(*keys, IDX, "Volume", _month(F.col(IDX), gran).alias("month")), "fresh-counts")
    old = sinks.read_table_or_none(spark, counts_path)
    before = None if old is None else written(_extent(old, keys), "extent")
    if start is None or old is None:
        months = sorted(r[0] for r in (fresh if old is None else fresh.select("month").unionByName(old.select("month"))).select("month").distinct().collect())
        _replace_months(spark, fresh, counts_path, months)
    else:
        months = _months(spark, first, last, gran)
        kept = old.where(F.col("month").isin(months) & ~F.col(IDX).between(first, last))
        _replace_months(spark, kept.unionByName(fresh.select(*kept.columns)), counts_path, months)
    table = sinks.read_table_or_none(spark, counts_path)
    if table is None:  # no event is left
        sinks.remove_path(spark, features_path)
        return Rebuilt(months, [])
    after = written(_extent(table, keys), "extent")
    whole = after.agg(F.min("_lo"), F.max("_hi")).first()
    low, high = whole
    if start is not None and before is not None:
        ends = join_on(before.withColumnsRenamed({"_lo": "_a", "_hi": "_b"}), after, keys, "full_outer") if keys else before.withColumnsRenamed({"_lo": "_a", "_hi": "_b"}).crossJoin(after)
        # a null end is a series that came or went: all of it lies in the stretch
        moved = ends.agg(F.min(F.when(F.col("_b") != F.col("_hi"), F.least("_b", "_hi") + 1)), F.max(F.when(F.col("_a") != F.col("_lo"), F.greatest("_a", "_lo"))),
                         F.min("_a"), F.max("_b")).first()
        low = min(x for x in (first, moved[0]) if x is not None)
        high = max(x for x in (last, moved[1]) if x is not None) + memory(gran)
        low, high = max(low, min(whole[0], moved[2])), min(high, max(whole[1], moved[3]))
        if low > high:
            return Rebuilt(months, [])
    touched = _months(spark, low, high, gran)
    cut = _feature_rows(table, after, gran, keys, touched)
    _replace_months(spark, cut, features_path, touched)
    return Rebuilt(months, touched)


def _feature_rows(counts: DataFrame, extent: DataFrame, gran: str, keys: list[str], months: list[str]) -> DataFrame:
    """Feature rows of ``months``, from their counts and those that they reach back to."""
    spark = counts.sparkSession
    g = granularity(gran)
    at = spark.range(1).select(period_index(F.lit(f"{months[0]}-01 00:00:00").cast("timestamp"), gran),
                               period_index(F.add_months(F.lit(f"{months[-1]}-01").cast("date"), 1).cast("timestamp"), gran)).first()
    low, high = at[0] - memory(gran) - lookback(gran), at[1]
    used = _months(spark, low, high, gran)
    part = counts.where(F.col("month").isin(used) & F.col(IDX).between(low, high)).drop("month")
    ends = (extent.select(*keys, F.greatest("_lo", F.lit(low)).alias("_lo"), F.least("_hi", F.lit(high)).alias("_hi")).where("_lo <= _hi"))
    filled = ingest.gap_fill(part, keys, gran, extent=ends)
    demand = filled.select(*keys, period_from_index(F.col(IDX), gran).alias("TimePeriod"), F.col("Volume").cast("long").alias("Volume"))
    rows = feat.nowcast_features(demand, gran, keys)
    return rows.withColumn("month", F.date_format(F.col("TimePeriod").cast("timestamp_ntz"), "yyyy-MM")).where(F.col("month").isin(months))
