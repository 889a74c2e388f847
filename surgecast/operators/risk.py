"""Residual risk: sigmas and the VaR band (A6, A7, M6, M7, J3, C9); see ``garch`` for M5."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_FALLBACK_SIGMA, FALLBACK_SIGMA, HOUR_SIGMA_FLOOR, HOUR_SIGMA_MIN_COUNT, granularity
from ..functions.calendar import hour_of_day
from ..functions.risk import band_columns
from .common import attach, join_on
from .garch import _finite, garch_sigma  # noqa: F401 - part of this module's surface


def residual_sigma(resid: DataFrame, series_cols=(), resid_col: str = "resid") -> DataFrame:
    """Population std of residuals per series."""
    return resid.groupBy(*series_cols).agg(F.count(resid_col).alias("n_resid"),
                                           F.stddev_pop(resid_col).alias("resid_sigma"))


def conditional_sigmas(resid: DataFrame, fallback: DataFrame, series_cols=(), resid_col: str = "resid",
                       ts_col: str = "TimePeriod", min_count: int = HOUR_SIGMA_MIN_COUNT,
                       floor: float = HOUR_SIGMA_FLOOR, fallback_col: str = "sigma") -> DataFrame:
    """Per hour-of-day residual sigma (A7): n >= min_count and all finite ->
    max(std_pop, floor); otherwise the series' fallback sigma (not floored)."""
    r = F.col(resid_col).cast("double")
    per_hour = (resid.groupBy(*series_cols, hour_of_day(F.col(ts_col)).alias("hour"))
                     .agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(r).alias("_std"),
                          F.count_if(~F.coalesce(_finite(r), F.lit(False))).alias("_bad")))
    fb = fallback.select(*series_cols, F.col(fallback_col).alias("_fb"))
    joined = attach(per_hour, fb, series_cols, how="left")
    sigma = F.when((F.col("n") >= F.lit(min_count)) & (F.col("_bad") == 0),
                   F.greatest(F.col("_std"), F.lit(floor))).otherwise(F.col("_fb"))
    return joined.select(*series_cols, "hour", "n", sigma.alias("hour_sigma"))


def hour_sigma_json(sigmas: DataFrame, series_cols=()) -> DataFrame:
    """Encode per-hour sigmas as the JSON tag stored on a model version (4 dp)."""
    return sigmas.groupBy(*series_cols).agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.col("hour").cast("string"), F.round("hour_sigma", 4))))).alias("hour_sigmas"))


def hour_sigma_lookup(forecasts: DataFrame, versions: DataFrame, series_cols=(), ts_col: str = "TimePeriod",
                      global_col: str = "garch_sigma") -> DataFrame:
    """Sigma for each forecast row: the per-hour value decoded from the version's
    JSON tag, falling back to its global sigma (J3, C9)."""
    decoded = versions.select(*series_cols, global_col, F.explode_outer(
        F.from_json(F.col("hour_sigmas"), "map<string,double>")).alias("_h", "_s"))
    per_hour = decoded.select(*series_cols, F.col("_h").cast("int").alias("_hour"), F.col("_s"))
    glob = versions.select(*series_cols, F.col(global_col).alias("_g"))
    f = forecasts.withColumn("_hour", hour_of_day(F.col(ts_col)))
    out = attach(join_on(f, per_hour, [*series_cols, "_hour"], "left"), glob, series_cols, how="left")
    return out.withColumn("sigma", F.coalesce(F.col("_s"), F.col("_g"))).drop("_hour", "_s", "_g")


def var_band(forecasts: DataFrame, point_col: str = "point", sigma_col: str = "sigma",
             confidence: float = 0.99) -> DataFrame:
    """Point (clipped), VaR buffer and capacity for every forecast row."""
    keep = [c for c in forecasts.columns if c not in (point_col, sigma_col)]
    return forecasts.select(*keep, *band_columns(F.col(point_col), F.col(sigma_col), confidence))


def sigma_or_fixed(sigma: str, gran: str) -> F.Column:
    """The sigma; a missing or zero one (too few, or perfectly met periods) becomes
    the fixed one of the granularity."""
    c = F.col(sigma)
    return F.when(c > 0, c).otherwise(F.lit(fixed_sigma(gran)))


def fixed_sigma(gran: str) -> float:
    """Sigma for a series with too little history to estimate one."""
    code = granularity(gran).code
    return FALLBACK_SIGMA[code] if code in FALLBACK_SIGMA else DEFAULT_FALLBACK_SIGMA
