"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key.

    The key columns of the result are the left side's (for an outer join that
    keeps right rows, whichever side has the row)."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if "outer" in how and how not in ("left_outer", "leftouter"):
        renamed = renamed.withColumn("_r_here", F.lit(True))
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if "_r_here" in out.columns:
        for k in keys:
            out = out.withColumn(k, F.when(F.col("_r_here"), F.col(f"_r_{k}")).otherwise(F.col(k)))
        out = out.drop("_r_here")
    return out.drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, per_series: DataFrame, series_cols=(), how: str = "inner") -> DataFrame:
    """Join per-series values back to rows on the series key (null keys match).

    Without a series key ``per_series`` is a single row; it is joined on a
    constant key as a broadcast, whose size is bounded by construction.
    """
    keys = list(series_cols)
    if keys:
        return join_on(df, per_series, keys, how)
    return (df.withColumn("_k", F.lit(1))
              .join(F.broadcast(per_series.withColumn("_k", F.lit(1))), on="_k", how=how)
              .drop("_k"))
