"""Forecast models and backtests (M1-M4, M8, F16).

Two models share one interface (a ``prediction`` column on a feature frame):
* seasonal-naive, ``max(0, LagS)``: a closed-form baseline;
* leaf-wise boosted trees (``boosting``), one model per granularity, trained on the
  whole panel, never a fit per series. A series enters as numbers (level and
  spread of its training rows), not as a category, so a panel may have any number
  of series and a new one is served from the panel's own level.

Both follow from integer sums and rounded inputs, so SQL can retrace them exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import GBT_LEAVES, GBT_MIN_INSTANCES, GBT_SMALL_LEAVES, GBT_SMALL_ROWS, GBT_STEP, GBT_TREES
from ..functions.risk import clip0, var_expr
from . import boosting
from .common import attach
from .risk import garch_sigma, residual_sigma

SERIES_STATS = ("_level", "_spread")


def seasonal_naive(frame: DataFrame, col: str = "LagS") -> DataFrame:
    return frame.withColumn("prediction", F.col(col).cast("double"))


#: Decimals of the trees' inputs: the last bits of a mean or a sine are no information.
INPUT_DP = 9


@dataclass
class PanelModel:
    """Fitted trees and, with series, the level and spread of each (one row a series)."""

    trees: boosting.Boosted | None
    stats: DataFrame | None
    features: list[str]
    series_cols: list[str]

    @property
    def inputs(self) -> list[str]:
        return [f"_in{i}" for i in range(len(self.features) + (len(SERIES_STATS) if self.series_cols else 0))]

    def encoded(self, frame: DataFrame) -> DataFrame:
        """``frame`` with the trees' inputs: the features and the series' numbers, rounded."""
        known = frame
        if self.stats is not None:
            whole = self.stats.agg(*[F.avg(c).alias(f"{c}_all") for c in SERIES_STATS])
            known = attach(attach(frame, self.stats, self.series_cols, how="left"), whole)
        values = [F.col(f).cast("double") for f in self.features]
        if self.stats is not None:
            values += [F.coalesce(c, f"{c}_all", F.lit(0.0)) for c in SERIES_STATS]
        return known.select(*frame.columns, *[(F.round(v, INPUT_DP) + F.lit(0.0)).alias(n) for v, n in zip(values, self.inputs)])

    def predict(self, frame: DataFrame) -> DataFrame:
        """``frame`` with ``prediction``; null where an input is missing (a series too
        short for its lags), an error where the trees give no finite number (F16)."""
        whole = _all_present(self.features)
        out = self.trees.predict(self.encoded(frame.where(whole))).select(*frame.columns, finite("prediction").alias("prediction"))
        return out.unionByName(frame.where(~whole).withColumn("prediction", F.lit(None).cast("double")))

    def save(self, path: str) -> None:
        self.trees.save(f"{path}/trees")
        if self.stats is not None:
            self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str, features, series_cols=()) -> "PanelModel":
        stats = spark.read.parquet(f"{path}/stats") if series_cols else None
        out = cls(None, stats, list(features), list(series_cols))
        out.trees = boosting.Boosted.load(spark, f"{path}/trees", out.inputs)
        return out


def _all_present(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def finite(col: str) -> Column:
    """The value; the query fails if it is not a finite number."""
    c = F.col(col)
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.raise_error(F.lit("a prediction is not a finite number")).cast("double")).otherwise(c)


def fit_gbt(frame: DataFrame, feature_cols, series_cols=(), trees: int = GBT_TREES, leaves: int = GBT_LEAVES,
            step: float = GBT_STEP, min_instances: int = GBT_MIN_INSTANCES) -> PanelModel:
    """Fit the panel model on rows with all inputs and a target ``y``."""
    features, keys = list(feature_cols), list(series_cols)
    rows = frame.where(_all_present([*features, "y"]))
    stats = None
    if keys:
        stats = rows.groupBy(*keys).agg(F.avg("y").alias("_level"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("_spread"))
    fitted = PanelModel(None, stats, features, keys)
    data = fitted.encoded(rows).select(*fitted.inputs, F.col("y").cast("double").alias("y"))
    fitted.trees = boosting.fit(data, fitted.inputs, "y", trees, leaves, min_instances, step)
    return fitted


def gbt_holdout(split: DataFrame, feature_cols, series_cols=(), leaves: int = GBT_LEAVES, **kw) -> DataFrame:
    """Fit on every series' 'train' rows, predict the 'test' rows (M3). With few rows
    in all, trees are kept small."""
    if split.limit(GBT_SMALL_ROWS).count() < GBT_SMALL_ROWS:
        leaves = min(leaves, GBT_SMALL_LEAVES)
    model = fit_gbt(split.filter(F.col("role") == "train"), feature_cols, series_cols, leaves=leaves, **kw)
    return model.predict(split.filter(F.col("role") == "test"))


def versus_naive(test_pred: DataFrame, series_cols=()) -> DataFrame:
    """Per series, on the same tail: rows, MAE of the model and of the seasonal-naive
    forecast, and whether the model is better."""
    mae = lambda c: F.avg(F.abs(F.col("y") - clip0(F.col(c))))
    out = test_pred.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("n"), mae("prediction").alias("model_mae"), mae("LagS").alias("naive_mae"))
    return out.withColumn("beats_naive", F.col("model_mae") < F.col("naive_mae"))


def residuals(test_pred: DataFrame, series_cols=(), clip: bool = True) -> DataFrame:
    p = clip0(F.col("prediction")) if clip else F.col("prediction")
    return test_pred.select(*series_cols, "TimePeriod", F.col("y"), p.alias("pred"),
                            (F.col("y") - p).alias("resid"))


def backtest_metrics(test_pred: DataFrame, series_cols=(), confidence: float = 0.99,
                     sigma: str = "std") -> DataFrame:
    """Per series: n, MAE, MAPE (actual floored at 1), one-sided band coverage and
    the sigma used (M4, A3-A5). ``sigma='std'`` uses the residual population std,
    ``'garch'`` the GARCH(1,1) estimate with that std as fallback."""
    res = residuals(test_pred, series_cols)
    sig = residual_sigma(res, series_cols)
    if sigma == "garch":
        g = garch_sigma(res, series_cols, fallback=sig, fallback_col="resid_sigma")
        sig = g.select(*series_cols, F.col("garch_sigma").alias("resid_sigma"))
    else:
        sig = sig.select(*series_cols, "resid_sigma")
    x = attach(res, sig, series_cols)
    upper = var_expr(F.col("pred"), F.col("resid_sigma"), confidence)
    err = F.abs(F.col("resid"))
    return x.groupBy(*series_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err).alias("mae"),
        (F.avg(err / F.greatest(F.col("y"), F.lit(1.0))) * 100).alias("mape"),
        (F.avg((F.col("y") <= upper).cast("double")) * 100).alias("coverage"),
        F.first("resid_sigma").alias("sigma"))
