"""Champion/challenger promotion over a table of candidate versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_on


def promotion_decision(candidates: DataFrame, champions: DataFrame, key_cols=("model",),
                       min_improvement: float = 0.0, mae_col: str = "holdout_mae") -> DataFrame:
    """Decide per candidate: 'champion', 'challenger' or 'rejected'.

    * null / NaN / +-inf MAE: rejected, never promoted;
    * MAE rounded to 6 dp; no incumbent champion: promoted;
    * champion without a recorded MAE counts as +inf;
    * promoted when ``mae <= champion_mae - min_improvement`` (ties win at 0).
    ``champions`` holds ``key_cols``, ``champion_version`` and ``champion_mae``.
    """
    m = F.col(mae_col).cast("double")
    bad = m.isNull() | F.isnan(m) | m.isin(float("inf"), float("-inf"))
    c = candidates.withColumn("_bad", bad).withColumn("_mae", F.when(~bad, F.round(m, 6)))
    j = join_on(c, champions, key_cols, "left")
    champ_mae = F.coalesce(F.col("champion_mae").cast("double"), F.lit(float("inf")))
    decision = (F.when(F.col("_bad"), F.lit("rejected"))
                 .when(F.col("champion_version").isNull(), F.lit("champion"))
                 .when(F.col("_mae") <= champ_mae - F.lit(float(min_improvement)), F.lit("champion"))
                 .otherwise(F.lit("challenger")))
    keep = [c for c in candidates.columns if c != mae_col]
    return j.select(*keep, F.col("_mae").alias(mae_col), "champion_version", "champion_mae",
                    decision.alias("decision"), (decision == "champion").alias("promoted"))


def next_model_versions(versions: DataFrame, decisions: DataFrame, key_cols=("model",)) -> DataFrame:
    """Append decided candidates to the version table and move aliases."""
    promoted = decisions.filter(F.col("promoted")).select(*key_cols, F.col("version").alias("_new"))
    old = join_on(versions, promoted, key_cols, "left").select(
        *[c for c in versions.columns if c != "alias"],
        F.when(F.col("_new").isNotNull() & (F.col("alias") == "champion"), F.lit("previous"))
         .otherwise(F.col("alias")).alias("alias"))
    made = [c for c in decisions.columns if c not in ("champion_version", "champion_mae", "decision", "promoted")]
    new = decisions.select(*made, F.col("decision").alias("alias"))
    return old.unionByName(new, allowMissingColumns=True)
