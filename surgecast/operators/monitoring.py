"""Scoring matured forecasts, concept drift, data drift and the retrain set."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..config import CONCEPT_DRIFT_THRESHOLD, DATA_DRIFT_SHARE
from ..session import written
from .common import attach, join_on
from .ranking import dealt


def score_forecasts(log: DataFrame, actuals: DataFrame, series_cols=()) -> DataFrame:
    """Per series: matured count, MAE (4 dp) and coverage % (2 dp) of forecasts whose
    period has an actual; a series with none gets 0 and nulls (J1, P1, A3, A5)."""
    keys = [*series_cols, "TimePeriod"]
    a = actuals.select(*keys, F.col("Volume").cast("double").alias("_actual"))
    j = join_on(log, a, keys, "left")
    err = F.abs(F.col("_actual") - F.col("Point_Forecast"))
    cov = F.when(F.col("_actual").isNotNull(), (F.col("_actual") <= F.col("Safety_Buffer_99")).cast("double"))
    return j.groupBy(*series_cols).agg(
        F.count("_actual").alias("n_matured"),
        F.round(F.avg(err), 4).alias("realised_mae"),
        F.round(F.avg(cov) * 100, 2).alias("coverage_99"))


def concept_drift(summary: DataFrame, baselines: DataFrame, series_cols=(),
                  threshold: float = CONCEPT_DRIFT_THRESHOLD) -> DataFrame:
    """Drift when realised MAE > baseline * (1 + threshold), only for series with
    matured rows and a non-null, non-zero champion baseline (P2, J5)."""
    b = baselines.select(*series_cols, F.col("baseline_mae").cast("double").alias("baseline_mae"))
    j = attach(summary, b, series_cols, how="left")
    drift = ((F.col("n_matured") > 0) & F.col("baseline_mae").isNotNull() & (F.col("baseline_mae") != 0)
             & (F.col("realised_mae") > F.col("baseline_mae") * F.lit(1 + threshold)))
    return j.withColumn("drift_detected", F.coalesce(drift, F.lit(False)))


def retrain_set(drift: DataFrame, series_cols=()) -> DataFrame:
    """Series whose drift flag is set: the input of the next training job."""
    return drift.filter(F.col("drift_detected")).select(*series_cols).distinct()


def mae_degradation(errors: DataFrame, series_cols=(), role_col: str = "window", err_col: str = "abs_err",
                    threshold: float = CONCEPT_DRIFT_THRESHOLD) -> DataFrame:
    """(current MAE - reference MAE) / (reference MAE + 1e-9), flagged above the
    threshold (A11). ``role_col`` holds 'reference' or 'current'."""
    e = F.col(err_col).cast("double")
    agg = errors.groupBy(*series_cols).agg(
        F.avg(F.when(F.col(role_col) == "reference", e)).alias("reference_mae"),
        F.avg(F.when(F.col(role_col) == "current", e)).alias("current_mae"))
    deg = (F.col("current_mae") - F.col("reference_mae")) / (F.col("reference_mae") + F.lit(1e-9))
    return agg.select("*", deg.alias("mae_degradation"), (deg > F.lit(threshold)).alias("concept_drift"))


def ks_critical(alpha: float = 0.05) -> float:
    return math.sqrt(-0.5 * math.log(alpha / 2.0))


JS_THRESHOLD = 0.1  # Jensen-Shannon distance from which a text column has drifted
EMD_THRESHOLD = 0.1  # earth-mover distance, in standard deviations of the reference, from which numbers have drifted
SMALL_REFERENCE = 1000  # rows of the reference up to which the tests for small samples decide


def value_counts(df: DataFrame, columns) -> DataFrame:
    """``(feature, kind, value, label, n)``: how often each value of each column
    occurs, numbers in ``value``, text in ``label``. Nulls and NaN are left out. A
    baseline is stored in this form."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        text = kinds[c] in ("string", "boolean")
        parts.append(F.struct(F.lit(c).alias("feature"), F.lit("categorical" if text else "numeric").alias("kind"),
                              (F.lit(None) if text else F.col(c)).cast("double").alias("value"),
                              (F.col(c) if text else F.lit(None)).cast("string").alias("label")))
    long = df.select(F.inline(F.array(*parts)))
    long = long.where((F.col("value").isNotNull() & ~F.isnan("value")) | F.col("label").isNotNull())
    return long.groupBy("feature", "kind", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def data_drift(reference: DataFrame, current: DataFrame, columns, alpha: float = 0.05,
               share_threshold: float = DATA_DRIFT_SHARE) -> DataFrame:
    """Drift of every column between two windows (P3); see ``drift_of_counts``."""
    return drift_of_counts(value_counts(reference, columns), value_counts(current, columns), columns, alpha, share_threshold)


def merged_counts(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Two ``value_counts`` tables side by side, written once: all that follows reads them
    more than once."""
    zero = F.lit(0).cast("long")
    both = (reference.select("feature", "kind", "value", "label", F.col("n").alias("c_ref"), zero.alias("c_cur"))
            .unionByName(current.select("feature", "kind", "value", "label", zero.alias("c_ref"), F.col("n").alias("c_cur"))))
    return written(both.groupBy("feature", "kind", "value", "label").agg(F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur")), "value-counts")


def numeric_measures(counts: DataFrame) -> DataFrame:
    """``(feature, n_reference, n_current, ks, emd)`` of the numeric columns.

    ks is the greatest gap between the two cumulative shares, emd the area between them
    in standard deviations of the reference (null where that is 0). Values are dealt by
    ranges of (feature, value), as many as the session has shuffle partitions; a range
    adds up its own counts on top of the totals of the ranges before it, and meets the
    first value of the next one. So no task holds a column, whatever its size."""
    values = dealt(counts.where("kind = 'numeric'").select("feature", "value", "c_ref", "c_cur"), ["feature"], ["value"])
    square = F.col("value") * F.col("value")
    ranges = values.groupBy("feature", "_part").agg(
        F.sum("c_ref").alias("_br"), F.sum("c_cur").alias("_bc"), F.min("value").alias("_first"),
        F.sum(F.col("value") * F.col("c_ref")).alias("_s"), F.sum(square * F.col("c_ref")).alias("_ss"))
    order = Window.partitionBy("feature").orderBy("_part")
    prior, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.try_divide(F.sum("_s").over(whole), F.sum("_br").over(whole))
    ranges = ranges.select("feature", "_part", F.coalesce(F.sum("_br").over(prior), F.lit(0)).alias("_or"), F.coalesce(F.sum("_bc").over(prior), F.lit(0)).alias("_oc"),
                           F.sum("_br").over(whole).alias("_N"), F.sum("_bc").over(whole).alias("_M"), F.lead("_first").over(order).alias("_next"),
                           F.sqrt(F.greatest(F.try_divide(F.sum("_ss").over(whole), F.sum("_br").over(whole)) - mean * mean, F.lit(0.0))).alias("_sd"))
    here = Window.partitionBy("feature", "_part").orderBy("value")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.sum("c_ref").over(upto) + F.col("_or"), F.col("_N")) - F.try_divide(F.sum("c_cur").over(upto) + F.col("_oc"), F.col("_M")))
    width = F.coalesce(F.coalesce(F.lead("value").over(here), F.col("_next")) - F.col("value"), F.lit(0.0))
    rows = values.join(ranges, ["feature", "_part"]).select("feature", "_N", "_M", "_sd", gap.alias("_gap"), width.alias("_width"))
    return rows.groupBy("feature").agg(F.first("_N").alias("n_reference"), F.first("_M").alias("n_current"), F.max("_gap").alias("ks"),
                                       F.try_divide(F.sum(F.col("_gap") * F.col("_width")), F.first("_sd")).alias("emd"))


def categorical_measures(counts: DataFrame) -> DataFrame:
    """``(feature, n_reference, n_current, js, chi2, chi2_critical)`` of the text columns:
    the Jensen-Shannon distance of the shares, and the chi-square statistic of the two
    sides with its 5% critical value (Wilson and Hilferty's approximation; null for a
    single category)."""
    text = counts.where("kind = 'categorical'")
    totals = text.groupBy("feature").agg(F.sum("c_ref").alias("n_reference"), F.sum("c_cur").alias("n_current"), F.count(F.lit(1)).alias("_k"))
    p, q = F.try_divide(F.col("c_ref"), F.col("n_reference")), F.try_divide(F.col("c_cur"), F.col("n_current"))
    m = (p + q) / 2
    part = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    pooled = F.try_divide((F.col("c_ref") + F.col("c_cur")).cast("double"), F.col("n_reference") + F.col("n_current"))
    off = lambda c, n: F.try_divide(F.pow(F.col(c) - pooled * F.col(n), 2), pooled * F.col(n))
    free = F.lit(2.0) / (9 * (F.first("_k") - 1))
    critical = F.when(F.first("_k") > 1, (F.first("_k") - 1) * F.pow(1 - free + F.lit(1.6448536269514722) * F.sqrt(free), 3))
    return text.join(totals, "feature").groupBy("feature").agg(
        F.first("n_reference").alias("n_reference"), F.first("n_current").alias("n_current"), F.sqrt(F.greatest(F.sum(part) / 2, F.lit(0.0))).alias("js"),
        F.sum(off("c_ref", "n_reference") + off("c_cur", "n_current")).alias("chi2"), critical.alias("chi2_critical"))


def _ks_threshold(alpha: float):
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    return F.lit(ks_critical(alpha)) * F.sqrt(F.try_divide(n + m, n * m))


def _judged(spark, found: DataFrame, columns, share_threshold: float) -> DataFrame:
    """A row per asked column of ``found (feature, kind, n_reference, n_current, ...,
    statistic, threshold)`` with the verdict, and why there is none."""
    asked = spark.createDataFrame([(c,) for c in columns], "feature string")  # a column without any value still has a row
    rows = asked.join(found, "feature", "left").fillna(0, ["n_reference", "n_current"])
    reason = F.when(F.col("n_current") == 0, "no current data").when(F.col("n_reference") == 0, "no reference data")
    rest = [c for c in found.columns if c not in ("feature", "kind", "n_reference", "n_current", "statistic", "threshold")]
    row = rows.select("feature", "kind", "n_reference", "n_current", *rest, F.when(reason.isNull(), F.col("statistic")).alias("statistic"),
                      F.when(reason.isNull(), F.col("threshold")).alias("threshold"),
                      F.coalesce(reason.isNull() & (F.col("statistic") > F.col("threshold")), F.lit(False)).alias("drifted"), reason.alias("reason"))
    # one row per checked column: a tiny single-partition window
    share = F.avg(F.col("drifted").cast("double")).over(Window.partitionBy(F.lit(1)))
    return row.select("*", share.alias("drift_share"), (share >= F.lit(share_threshold)).alias("dataset_drift"))


def drift_of_counts(reference: DataFrame, current: DataFrame, columns, alpha: float = 0.05,
                    share_threshold: float = DATA_DRIFT_SHARE) -> DataFrame:
    """A row per column from two ``value_counts`` tables: rows on either side, the
    statistic, its threshold, whether it drifted, and why not where a side is empty.

    Numbers: exact two-sample Kolmogorov-Smirnov with its asymptotic critical value.
    Text: Jensen-Shannon distance of the shares."""
    counts = merged_counts(reference, current)
    ks = numeric_measures(counts).select("feature", F.lit("numeric").alias("kind"), "n_reference", "n_current", F.col("ks").alias("statistic"),
                                         _ks_threshold(alpha).alias("threshold"))
    js = categorical_measures(counts).select("feature", F.lit("categorical").alias("kind"), "n_reference", "n_current", F.col("js").alias("statistic"),
                                             F.lit(JS_THRESHOLD).alias("threshold"))
    return _judged(reference.sparkSession, ks.unionByName(js), columns, share_threshold)


def drift_by_size(reference: DataFrame, current: DataFrame, columns, alpha: float = 0.05, share_threshold: float = DATA_DRIFT_SHARE,
                  small: int = SMALL_REFERENCE) -> DataFrame:
    """As ``data_drift``, with the test that suits each column's kind and size, named in
    ``test``: numbers by Kolmogorov-Smirnov, text by chi-square where the reference has at
    most ``small`` rows, else by earth-mover and Jensen-Shannon distance. Large samples
    make any difference significant, so there the distance decides."""
    counts = merged_counts(value_counts(reference, columns), value_counts(current, columns))
    few = F.col("n_reference") <= small
    pick = lambda kind, rows, a, b: rows.select(
        "feature", F.lit(kind).alias("kind"), "n_reference", "n_current", F.when(few, a[0]).otherwise(b[0]).alias("test"),
        F.when(few, a[1]).otherwise(b[1]).alias("statistic"), F.when(few, a[2]).otherwise(b[2]).alias("threshold"))
    numbers = pick("numeric", numeric_measures(counts), ("ks", F.col("ks"), _ks_threshold(alpha)), ("earth-mover", F.col("emd"), F.lit(EMD_THRESHOLD)))
    text = pick("categorical", categorical_measures(counts), ("chi-square", F.col("chi2"), F.col("chi2_critical")),
                ("jensen-shannon", F.col("js"), F.lit(JS_THRESHOLD)))
    return _judged(reference.sparkSession, numbers.unionByName(text), columns, share_threshold)


def drift_summary(drift: DataFrame, degradation: DataFrame) -> DataFrame:
    """One row out of ``data_drift`` and ``mae_degradation`` rows: whether the data,
    the errors or either have drifted, or why nothing can be said."""
    d = drift.agg(F.first("drift_share").alias("drift_share"), F.first("dataset_drift").alias("data_drift_detected"),
                  F.sum("n_current").alias("_n"))
    m = degradation.agg(F.max("mae_degradation").alias("mae_degradation"), F.coalesce(F.bool_or("concept_drift"), F.lit(False)).alias("concept_drift_detected"))
    none = F.coalesce(F.col("_n"), F.lit(0)) == 0
    seen = lambda c: ~none & F.coalesce(c, F.lit(False))
    return attach(d, m).select(
        F.round("drift_share", 4).alias("drift_share"), seen(F.col("data_drift_detected")).alias("data_drift_detected"),
        F.round("mae_degradation", 4).alias("mae_degradation"), seen(F.col("concept_drift_detected")).alias("concept_drift_detected"),
        seen(F.col("data_drift_detected") | F.col("concept_drift_detected")).alias("drift_detected"),
        F.when(none, "no current data").alias("reason"))
