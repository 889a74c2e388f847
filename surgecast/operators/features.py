"""Time-series features.

All windows partition by ``series_cols`` plus a block id (see ``windows``) and
order by the period index, so Catalyst evaluates every lag, frame and running
sum of one feature set in a single Window operator after a single shuffle.
Inputs must be regular series: (series..., TimePeriod, Volume) as produced by
``ingest.demand`` (gap-filled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FEATURE_VIEW_FIELDS, FORECAST_FIELDS, HOLDOUT_FRACTION, MIN_TRAIN_ROWS, granularity
from ..functions.calendar import calendar_columns, entity_key
from ..functions.timestamps import period_from_index, period_index
from .common import attach
from .windows import (DEFAULT_BLOCK, IDX, block_window, drop_halo, ema_block_size, gap_column,
                      ema_local, ema_summary, finish_ema, with_blocks)


def _indexed(df: DataFrame, gran: str) -> DataFrame:
    return df.withColumn(IDX, period_index(F.col("TimePeriod"), gran))


def _full(value: Column, n: int, frame: Window, agg) -> Column:
    """Aggregate over a frame, null until the frame holds ``n`` rows."""
    return F.when(F.count(value).over(frame) == F.lit(n), agg(value).over(frame))


def nowcast_columns(gran: str, series_cols=(), lags=None, rolling=None, spans=None,
                    block_size: int = DEFAULT_BLOCK) -> tuple[list[Column], list[tuple[str, int, str]]]:
    g = granularity(gran)
    lags = g.lags if lags is None else lags
    rolling = g.rolling if rolling is None else rolling
    spans = g.ema_spans if spans is None else spans
    w = block_window(series_cols)
    v = F.col("Volume").cast("double")
    cols: list[Column] = []
    for n in lags:
        lag = F.lag(v, n).over(w)
        cols += [lag.alias(f"Volume_Lag{n}"), (v - lag).alias(f"Volume_LagDelta{n}")]
    for n in rolling:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        cols += [_full(v, n, frame, F.avg).alias(f"Volume_RollingMean{n}"),
                 _full(v, n, frame, F.stddev_samp).alias(f"Volume_RollingStd{n}")]
    ema = [(f"_L{s}", s, f"Volume_EMA{s}") for s in spans]
    cols += [ema_local(v, s, series_cols, block_size).alias(local) for local, s, _ in ema]
    return cols, ema


def window_features(df: DataFrame, gran: str, series_cols=(), lags=None, rolling=None, spans=None,
                    calendar: bool = True, regime: bool = True, dropna: bool = False,
                    block_size: int | None = None) -> DataFrame:
    """Lags, lag deltas, rolling mean/std, EMAs, calendar cycles and regime flags.

    ``dropna`` drops rows with any null feature (the nowcast frame, W8).
    """
    g = granularity(gran)
    lags = g.lags if lags is None else tuple(lags)
    rolling = g.rolling if rolling is None else tuple(rolling)
    spans = g.ema_spans if spans is None else tuple(spans)
    if any(sp <= 1 for sp in spans):
        raise ValueError("EMA spans must be greater than 1")
    lookback = max([0, *lags, *[n - 1 for n in rolling]])
    if block_size is None:
        block_size = DEFAULT_BLOCK
    if spans:
        # the in-block EMA sum scales by q^-j, which must stay finite
        block_size = min(block_size, ema_block_size(spans))
    block_size = max(block_size, lookback)
    base_cols = [c for c in df.columns]
    x = with_blocks(_indexed(df, gran), lookback, block_size, series_cols)
    cols, ema = nowcast_columns(gran, series_cols, lags, rolling, spans, block_size)
    summary = (ema_summary(x, F.col("Volume"), series_cols, [s for _, s, _ in ema], block_size)
               if ema else None)
    x = drop_halo(x.select("*", *cols, gap_column(series_cols)))
    if ema:
        x = finish_ema(x, summary, series_cols, [s for _, s, _ in ema], [l for l, _, _ in ema],
                       [o for _, _, o in ema], block_size)
    feats = [c for c in x.columns if c not in base_cols and not c.startswith("_")]
    extra: list[Column] = []
    if calendar:
        extra += calendar_columns(F.col("TimePeriod"), gran, with_raw=True)
    if regime and "Regime_0" not in df.columns:
        extra += [F.lit(1.0).alias("Regime_0"), F.lit(0.0).alias("Regime_1"), F.lit(0.0).alias("Regime_2")]
    out = x.select(*base_cols, *feats, *extra)
    if dropna:
        out = out.dropna()
    return out


def lag_features(df, gran="D", series_cols=(), **kw):
    return window_features(df, gran, series_cols, rolling=(), spans=(), calendar=False, regime=False, **kw)


def rolling_features(df, gran="D", series_cols=(), **kw):
    return window_features(df, gran, series_cols, lags=(), spans=(), calendar=False, regime=False, **kw)


def ema_features(df, gran="D", series_cols=(), **kw):
    return window_features(df, gran, series_cols, lags=(), rolling=(), calendar=False, regime=False, **kw)


def cyclical_features(df, gran="H"):
    return df.select("*", *calendar_columns(F.col("TimePeriod"), gran, with_raw=True))


def nowcast_features(df, gran="D", series_cols=(), **kw):
    """The full nowcast frame with incomplete rows dropped."""
    return window_features(df, gran, series_cols, dropna=True, **kw)


# ---------------------------------------------------------------- past-only block

def feature_columns(gran: str) -> list[str]:
    """Declared inputs of the forecast model."""
    return list(FORECAST_FIELDS[granularity(gran).code])


def _season(gran: str) -> int:
    g = granularity(gran)
    if g.season is None:
        raise ValueError("past-only features support granularity 'D' or 'H'")
    return g.season


def _past_only(x: DataFrame, gran: str, series_cols, block_size: int) -> DataFrame:
    S = _season(gran)
    w = block_window(series_cols)
    v = F.col("Volume").cast("double")
    lag1, lag2 = F.lag(v, 1).over(w), F.lag(v, 2).over(w)
    frame = w.rowsBetween(-S, -1)
    cols = [lag1.alias("Lag1"), F.lag(v, S).over(w).alias("LagS"), (lag1 - lag2).alias("PrevDelta1"),
            (lag1 - F.lag(v, S + 1).over(w)).alias("PrevDeltaS"),
            _full(v, S, frame, F.avg).alias("RollMean"), _full(v, S, frame, F.stddev_samp).alias("RollStd")]
    return drop_halo(with_blocks(x, S + 1, block_size, series_cols).select("*", *cols, gap_column(series_cols)))


def past_only_features(df: DataFrame, gran: str = "D", series_cols=(), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Features for period t from values strictly before t, plus t's calendar.

    Lag1=V[t-1], LagS=V[t-S], PrevDelta1=V[t-1]-V[t-2], PrevDeltaS=V[t-1]-V[t-1-S],
    RollMean/RollStd over V[t-S..t-1] (sample std, null until S values).
    """
    base = list(df.columns)
    x = _past_only(_indexed(df, gran), gran, series_cols, block_size)
    cal = calendar_columns(F.col("TimePeriod"), gran)
    return x.select(*base, "Lag1", "LagS", "PrevDelta1", "PrevDeltaS", "RollMean", "RollStd", *cal)


def training_frame(df: DataFrame, gran: str = "D", series_cols=(), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """(series..., TimePeriod, features..., y) with incomplete rows dropped."""
    feats = past_only_features(df, gran, series_cols, block_size)
    cols = feature_columns(gran)
    return (feats.select(*series_cols, "TimePeriod", *cols, F.col("Volume").cast("double").alias("y"))
                 .dropna(subset=[*cols, "y"]))


def next_step_features(df: DataFrame, gran: str = "D", series_cols=()) -> DataFrame:
    """One row per series: the past-only features of the period after its last one.

    Only the last S+2 periods of each series are kept (a group-limited window,
    limited per partition before its shuffle); an empty row for the next period
    is appended and flagged, and the same past-only window as W5 runs over
    these few rows.
    """
    S = _season(gran)
    x = _indexed(df, gran).select(*series_cols, "TimePeriod", F.col("Volume").cast("double").alias("Volume"), IDX)
    w = Window.partitionBy(*series_cols).orderBy(F.col(IDX).desc())
    tail = x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= S + 2)
    # the latest row of each series also emits the (empty) next period
    k = F.explode(F.when(F.col("_rn") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    both = tail.select("*", k.alias("_k")).select(
        *series_cols,
        F.when(F.col("_k") == 1, period_from_index(F.col(IDX) + 1, gran)).otherwise(F.col("TimePeriod")).alias("TimePeriod"),
        F.when(F.col("_k") == 0, F.col("Volume")).alias("Volume"),
        (F.col(IDX) + F.col("_k")).alias(IDX),
        (F.col("_k") == 1).alias("_next"))
    feats = _past_only(both, gran, series_cols, block_size=max(DEFAULT_BLOCK, 2 * (S + 2)))
    return feats.filter(F.col("_next")).select(*series_cols, "TimePeriod", *feature_columns(gran)[:6],
                                               *calendar_columns(F.col("TimePeriod"), gran))


def series_extent(df: DataFrame, gran: str, series_cols=()) -> DataFrame:
    return (df.groupBy(*series_cols)
              .agg(F.min(period_index(F.col("TimePeriod"), gran)).alias("_first"),
                   F.max(period_index(F.col("TimePeriod"), gran)).alias("_lastp")))


def holdout_split(frame: DataFrame, gran: str, series_cols=(), fraction: float = HOLDOUT_FRACTION,
                  min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Chronological split of a training frame: first floor(n*fraction) rows are
    'train', the rest 'test' (W9). Series with fewer than ``min_rows`` rows get
    role 'insufficient_data'. Row numbers come from the period index (the frame
    is contiguous), so no sort over a whole series is needed.
    """
    ext = series_extent(frame, gran, series_cols)
    x = attach(frame, ext, series_cols)
    n = F.col("_lastp") - F.col("_first") + 1
    rn = period_index(F.col("TimePeriod"), gran) - F.col("_first") + 1
    split = F.floor(n.cast("double") * F.lit(fraction))
    role = (F.when(n < F.lit(min_rows), F.lit("insufficient_data"))
             .when(rn <= split, F.lit("train")).otherwise(F.lit("test")))
    return x.select(*frame.columns, n.alias("n_rows"), rn.alias("rn"), role.alias("role")).drop("_first", "_lastp")


def latest_periods(df: DataFrame, n: int, series_cols=(), ts_col: str = "TimePeriod") -> DataFrame:
    """Last ``n`` periods of each series (W10). ``row_number <= n`` lets Spark run a
    per-partition group limit before the shuffle."""
    w = Window.partitionBy(*series_cols).orderBy(F.col(ts_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_row(df: DataFrame, series_cols=(), ts_col: str = "TimePeriod") -> DataFrame:
    """Latest row per series via ``max_by`` (W11): a partial aggregate, skew-safe."""
    others = [c for c in df.columns if c not in series_cols]
    agg = df.groupBy(*series_cols).agg(F.max_by(F.struct(*others), F.col(ts_col)).alias("_r"))
    return agg.select(*series_cols, *[F.col(f"_r.{c}").alias(c) for c in others])


def online_latest(df: DataFrame, as_of, ttl_us: int, entity_cols, ts_col: str = "TimePeriod") -> DataFrame:
    """Online-store view: latest row per entity whose time lies in (as_of - ttl, as_of]."""
    hi = F.lit(str(as_of)).cast("timestamp")
    lo = F.timestamp_micros(F.unix_micros(hi) - F.lit(int(ttl_us)))
    fresh = df.filter((F.col(ts_col).cast("timestamp") > lo) & (F.col(ts_col).cast("timestamp") <= hi))
    return latest_row(fresh, entity_cols, ts_col)


def offline_features(df: DataFrame, gran: str, series_cols=()) -> DataFrame:
    """Nowcast features + entity key + partition columns for the offline store."""
    feats = nowcast_features(df, gran, series_cols)
    return feats.select("*", entity_key(F.col("TimePeriod"), gran).alias("time_period"),
                        F.lit(gran.upper()).alias("granularity"),
                        F.date_format(F.col("TimePeriod").cast("timestamp_ntz"), "yyyy-MM").alias("month"))


def feature_view(df: DataFrame, gran: str, series_cols=(), fields=None) -> DataFrame:
    """Declared-field projection; declared fields missing from the input become 0.0."""
    fields = FEATURE_VIEW_FIELDS[gran.upper()] if fields is None else fields
    present = set(df.columns)
    cols = [F.col(f).cast("double").alias(f) if f in present else F.lit(0.0).alias(f) for f in fields]
    keys = [c for c in (*series_cols, "TimePeriod", "time_period") if c in present]
    return df.select(*keys, *cols)
