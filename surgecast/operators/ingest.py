"""Ingest: clean event times, count events per period, fill empty periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..config import RANGE_FILTER_MIN_TS, granularity
from ..functions.timestamps import coerce_timestamp, period_from_index, period_index, resolve_ts_column, to_utc
from .common import join_on
from .windows import DEFAULT_BLOCK, IDX


def _lit_like(df: DataFrame, col: str, value) -> F.Column:
    """A literal of the column's own timestamp type, so range predicates push down."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, TimestampNTZType):
        return F.lit(str(value)).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp")


def range_filter(df: DataFrame, ts_col: str, as_of, min_ts: str = RANGE_FILTER_MIN_TS) -> DataFrame:
    """Keep ``min_ts <= ts <= as_of`` (F4). ``as_of`` replaces the wall clock and must
    be given: one stamp in the far future would stretch every filled series to it.

    Written as plain range predicates on the scanned column so they reach the
    Parquet reader as pushed filters.
    """
    if as_of is None:
        raise ValueError("as_of is needed: the latest time that an event may have")
    return df.filter((F.col(ts_col) >= _lit_like(df, ts_col, min_ts)) & (F.col(ts_col) <= _lit_like(df, ts_col, as_of)))


def bound_as_of(df: DataFrame, as_of, ts_col: str = "TimePeriod") -> DataFrame:
    """Execution-date bound ``ts <= as_of``, inclusive."""
    return df.filter(F.col(ts_col) <= _lit_like(df, ts_col, as_of))


def recent_window(df: DataFrame, as_of, days: int = 7, ts_col: str = "TimePeriod") -> DataFrame:
    """Trailing window: rows with ``ts >= as_of - days``."""
    lo = F.lit(str(as_of)).cast("timestamp") - F.make_dt_interval(F.lit(days))
    dtype = df.schema[ts_col].dataType
    if isinstance(dtype, TimestampNTZType):
        lo = lo.cast("timestamp_ntz")
    return df.filter(F.col(ts_col) >= lo)


def clean_events(df: DataFrame, ts_col: str | None = None, source_tz: str | None = None, *,
                 as_of, min_ts: str = RANGE_FILTER_MIN_TS, keep=()) -> DataFrame:
    """Resolve, coerce and UTC-normalise the event time, then range-filter it.

    Returns ``keep`` columns plus ``ts_col`` as a UTC TIMESTAMP. Unparseable or
    null times are dropped. Rows are never de-duplicated: each record is an event.
    """
    ts_col = ts_col or resolve_ts_column(df)
    dtype = df.schema[ts_col].dataType
    native = isinstance(dtype, (TimestampType, TimestampNTZType)) and not source_tz
    if native:
        # Filter on the scanned column itself so Parquet sees the predicates.
        df = range_filter(df.filter(F.col(ts_col).isNotNull()), ts_col, as_of, min_ts)
        return df.select(*keep, to_utc(F.col(ts_col)).alias(ts_col))
    parsed = df.select(*keep, to_utc(coerce_timestamp(df, ts_col), source_tz).alias(ts_col))
    parsed = parsed.filter(F.col(ts_col).isNotNull())
    return range_filter(parsed, ts_col, as_of, min_ts)


def count_per_period(df: DataFrame, ts_col: str, gran: str, series_cols=()) -> DataFrame:
    """Events per (series, period) (A1). Partial aggregation runs before the
    shuffle, so a hot series costs one row per period per task."""
    return (df.groupBy(*series_cols, period_index(F.col(ts_col), gran).alias(IDX))
              .agg(F.count(F.lit(1)).alias("Volume")))


def _series_bounds(agg: DataFrame, series_cols, bounds: str) -> DataFrame:
    # Bounds read the counted rows (Volume > 0 always holds there): written on the
    # grouping key alone, Catalyst would re-aggregate the raw scan instead of
    # reusing the count's shuffle.
    present = F.col("Volume") > 0
    b = agg.groupBy(*series_cols).agg(F.min(F.when(present, F.col(IDX))).alias("_lo"),
                                      F.max(F.when(present, F.col(IDX))).alias("_hi"))
    if bounds == "series" or not series_cols:
        return b
    if bounds != "global":
        raise ValueError("bounds must be 'series' or 'global'")
    g = b.agg(F.min("_lo").alias("_glo"), F.max("_hi").alias("_ghi")).withColumn("_k", F.lit(1))
    # One-row side: broadcast is bounded by construction.
    return (b.withColumn("_k", F.lit(1)).join(F.broadcast(g), "_k")
             .select(*series_cols, F.col("_glo").alias("_lo"), F.col("_ghi").alias("_hi")))


def gap_fill(agg: DataFrame, series_cols, gran: str, value_cols=("Volume",), bounds: str = "series",
             chunk: int = DEFAULT_BLOCK, extent: DataFrame | None = None) -> DataFrame:
    """Emit every period between each series' first and last period; missing
    periods get 0 (J6). Expects ``_idx`` on ``agg``. ``extent (series..., _lo, _hi)``
    gives other ends, where ``agg`` is a slice of its series.

    The calendar is generated in two levels (chunks of ``chunk`` periods, then
    periods), so no single array holds a whole series, and joined back on the
    (series, period) key.
    """
    b = _series_bounds(agg, series_cols, bounds) if extent is None else extent
    C = F.lit(int(chunk))
    chunks = b.select(*series_cols, "_lo", "_hi",
                      F.explode(F.sequence(F.floor(F.col("_lo") / C), F.floor(F.col("_hi") / C))).alias("_c"))
    # spread the chunks of one long series over tasks before expanding them
    chunks = chunks.repartition(*series_cols, "_c")
    cal = chunks.select(*series_cols, F.explode(F.sequence(
        F.greatest(F.col("_lo"), F.col("_c") * C),
        F.least(F.col("_hi"), F.col("_c") * C + C - 1))).alias(IDX))
    # Union + grouped sum instead of a join: no join-inferred filters, so the
    # count shuffle feeding both the bounds and this union stays one shared stage.
    zeros = cal.select(*series_cols, IDX, *[F.lit(0).cast("long").alias(v) for v in value_cols])
    both = agg.select(*series_cols, IDX, *[F.col(v).cast("long").alias(v) for v in value_cols]).unionByName(zeros)
    return both.groupBy(*series_cols, IDX).agg(*[F.sum(v).alias(v) for v in value_cols])


def demand(df: DataFrame, ts_col: str, gran: str, series_cols=(), fill: bool = True,
           bounds: str = "series") -> DataFrame:
    """(series..., TimePeriod TIMESTAMP, Volume BIGINT): gap-filled counts (A1+J6)."""
    granularity(gran)
    return demand_of_counts(count_per_period(df, ts_col, gran, series_cols), gran, series_cols, fill, bounds)


def coarser_counts(agg: DataFrame, gran: str, to_gran: str, series_cols=()) -> DataFrame:
    """Counts per coarser period out of counts per finer one."""
    return (agg.groupBy(*series_cols, period_index(period_from_index(F.col(IDX), gran), to_gran).alias("_to"))
               .agg(F.sum("Volume").alias("Volume")).withColumnRenamed("_to", IDX))


def demand_of_counts(agg: DataFrame, gran: str, series_cols=(), fill: bool = True, bounds: str = "series") -> DataFrame:
    if fill:
        agg = gap_fill(agg, series_cols, gran, bounds=bounds)
    return agg.select(*series_cols, period_from_index(F.col(IDX), gran).alias("TimePeriod"),
                      F.col("Volume").cast("long").alias("Volume"))


def rollup(df: DataFrame, to_gran: str, series_cols=(), value_col: str = "Volume") -> DataFrame:
    """Re-aggregate a finer series into coarser periods (A2): daily = sum of hourly.

    Rolling up the gap-filled hourly table reads the raw events only once.
    """
    return (df.groupBy(*series_cols, period_index(F.col("TimePeriod"), to_gran).alias(IDX))
              .agg(F.sum(value_col).cast("long").alias(value_col))
              .select(*series_cols, period_from_index(F.col(IDX), to_gran).alias("TimePeriod"), value_col))


def rollup_consistency(hourly: DataFrame, daily: DataFrame, series_cols=()) -> DataFrame:
    """Per (series, day): hourly sum vs daily count and whether they agree."""
    h = rollup(hourly, "D", series_cols).withColumnRenamed("Volume", "hourly_sum")
    d = daily.withColumnRenamed("Volume", "daily_volume")
    out = join_on(h, d, [*series_cols, "TimePeriod"], "full_outer")
    return out.select(*series_cols, "TimePeriod", "hourly_sum", "daily_volume",
                      (F.coalesce(F.col("hourly_sum"), F.lit(-1)) ==
                       F.coalesce(F.col("daily_volume"), F.lit(-2))).alias("consistent"))


def data_profile(df: DataFrame, series_cols=(), ts_col: str = "TimePeriod") -> DataFrame:
    """Rows, first and last period per series (A10)."""
    return df.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.min(ts_col).alias("first_period"),
                                        F.max(ts_col).alias("last_period"))
