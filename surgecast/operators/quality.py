"""Schema/bounds gate and row-count gate.

All rules are evaluated in one aggregate pass and reported together; ``strict``
callers raise on any violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import MIN_ROWS_GATE, VOLUME_MAX, VOLUME_MIN

RULES = ("null_period", "null_volume", "nan_volume", "inf_volume", "negative_volume", "above_max_volume")


class DataQualityError(ValueError):
    pass


def _rule_exprs(ts_col: str, vol_col: str):
    v = F.col(vol_col).cast("double")
    finite = ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))
    return {
        "null_period": F.col(ts_col).isNull(),
        "null_volume": v.isNull(),
        "nan_volume": F.isnan(v),
        "inf_volume": v.isin(float("inf"), float("-inf")),
        "negative_volume": v < F.lit(VOLUME_MIN),
        "above_max_volume": finite & (v > F.lit(VOLUME_MAX)),
    }


def quality_violations(df: DataFrame, series_cols=(), ts_col: str = "TimePeriod", vol_col: str = "Volume",
                       min_rows: int = MIN_ROWS_GATE) -> DataFrame:
    """One row per series: row count, per-rule violation counts, invalid rows,
    the min-rows gate and an overall ``passed`` flag."""
    rules = _rule_exprs(ts_col, vol_col)
    any_bad = None
    for cond in rules.values():
        c = F.coalesce(cond, F.lit(False))
        any_bad = c if any_bad is None else (any_bad | c)
    agg = df.groupBy(*series_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()],
        F.count_if(any_bad).alias("invalid_rows"))
    return agg.select("*", (F.col("n_rows") < F.lit(min_rows)).alias("below_min_rows"),
                      ((F.col("invalid_rows") == 0) & (F.col("n_rows") >= F.lit(min_rows))).alias("passed"))


def validate_demand(df: DataFrame, ts_col: str = "TimePeriod", vol_col: str = "Volume") -> DataFrame:
    """Typed demand frame (TimePeriod TIMESTAMP, Volume DOUBLE); extra columns kept.
    Use ``assert_quality`` to enforce the bounds."""
    missing = [c for c in (ts_col, vol_col) if c not in df.columns]
    if missing:
        raise DataQualityError(f"missing columns: {missing}")
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withColumn(vol_col, F.col(vol_col).cast("double"))


def assert_quality(df: DataFrame, min_rows: int = MIN_ROWS_GATE, series_cols=(), ts_col="TimePeriod",
                   vol_col="Volume", report_path: str | None = None) -> int:
    """Raise if any series is too short or violates a rule; return the row count.

    One pass over the data. The full report (a row per series) is written to
    ``report_path`` if given; the error counts the failing series and, of each rule,
    the rows.
    """
    report = quality_violations(validate_demand(df, ts_col, vol_col), series_cols, ts_col, vol_col, min_rows)
    if report_path:
        report.write.mode("overwrite").parquet(report_path)
        report = df.sparkSession.read.parquet(report_path)
    total = report.agg(F.sum("n_rows").alias("n_rows"), F.count_if(~F.col("passed")).alias("failed"),
                       F.count_if("below_min_rows").alias("short"), *[F.sum(rule).alias(rule) for rule in RULES]).first()
    if total["failed"] or not total["n_rows"]:
        rules = ", ".join(f"{rule} {total[rule]}" for rule in RULES if total[rule])
        raise DataQualityError(f"{total['failed']} series fail the quality gate (too short: {total['short']}; rows: {rules or 'none bad'})")
    return int(total["n_rows"])
