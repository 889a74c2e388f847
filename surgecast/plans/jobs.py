"""Pipeline jobs.

Every job is idempotent for a given ``as_of``: inputs are bounded by it, aggregate
writes overwrite, the forecast log and the version table are keyed upserts. The
jobs form a loop: ingest -> validate -> train (holdout errors, sigmas, promotion,
version table, saved model) -> infer (champions only, behind the quality gate) ->
monitor (against the champion's error) -> the series to train next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import GBT_LEAVES, GBT_TREES, MIN_ROWS_GATE, RECENT_WINDOW
from ..functions.risk import band_columns
from ..functions.timestamps import resolve_ts_column
from ..operators import features as feat, ingest, model, monitoring, pii, promotion, quality, risk
from ..operators.common import attach, join_on
from ..sources import files, sinks


def ingest_job(spark: SparkSession, source: dict, out_root: str, as_of, ts_col: str | None = None,
               series_cols=(), source_tz: str | None = None) -> dict:
    """Raw events of ``source`` (see ``files.read_source``) -> cleaned UTC times up to
    ``as_of`` -> hourly and daily counts (gap-filled), both overwritten -> gate against
    personal data in what is published. Of the raw table only the event time and the
    series keys are read."""
    raw = files.read_source(spark, source)
    ts_col = ts_col or resolve_ts_column(raw)
    raw, report = pii.without_pii_columns(raw.select(*dict.fromkeys([ts_col, *series_cols])))
    keys = [c for c in series_cols if c in raw.columns]
    if len(keys) < len(series_cols):
        raise pii.PersonalDataFound(f"series keys hold personal data: {sorted(set(series_cols) - set(keys))}")
    clean = ingest.clean_events(raw, ts_col, source_tz=source_tz, as_of=as_of, keep=keys)
    sinks.write_aggregate(ingest.demand(clean, ts_col, "H", keys), f"{out_root}/hourly")
    sinks.write_aggregate(ingest.rollup(spark.read.parquet(f"{out_root}/hourly"), "D", keys), f"{out_root}/daily")
    for name in ("hourly", "daily"):
        pii.pii_gate(spark.read.parquet(f"{out_root}/{name}"))
    return {"pii_report": report, "hourly": f"{out_root}/hourly", "daily": f"{out_root}/daily"}


def validate_job(spark: SparkSession, agg_path: str, min_rows: int = MIN_ROWS_GATE, series_cols=()) -> int:
    """Data-quality gate: the row count, or an error that stops the chain."""
    if not files.path_exists(spark, agg_path):
        raise FileNotFoundError(f"nothing to validate at {agg_path}")
    return quality.assert_quality(spark.read.parquet(agg_path), min_rows, series_cols)


def evaluate(split: DataFrame, gran: str, series_cols=(), trees: int = GBT_TREES, leaves: int = GBT_LEAVES) -> DataFrame:
    """Per series, from the model's own residuals on the held-out tail: error,
    GARCH sigma, hour sigmas (hourly series), status. A series too short to hold a
    tail out keeps the fixed sigma and an infinite error, so it is never promoted."""
    keys = list(series_cols)
    tail = model.gbt_holdout(split, feat.feature_columns(gran), keys, trees=trees, leaves=leaves)
    res = model.residuals(tail, keys, clip=False).checkpoint()
    mae = res.groupBy(*keys).agg(F.avg(F.abs("resid")).alias("holdout_mae"))
    sig = risk.garch_sigma(res, keys, fallback=risk.residual_sigma(res, keys)).select(*keys, "garch_sigma")
    sig = sig.select(*keys, risk.sigma_or_fixed("garch_sigma", gran).alias("garch_sigma"))
    rows = split.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"))
    out = attach(rows, attach(mae, sig, keys), keys, how="left")
    if gran.upper() == "H":
        hours = risk.hour_sigma_json(risk.conditional_sigmas(res, sig, keys, fallback_col="garch_sigma"), keys)
        out = attach(out, hours, keys, how="left")
    else:
        out = out.withColumn("hour_sigmas", F.lit(None).cast("string"))
    return out.select(*keys, "n_rows", F.coalesce("holdout_mae", F.lit(float("inf"))).alias("holdout_mae"),
                      risk.sigma_or_fixed("garch_sigma", gran).alias("garch_sigma"), "hour_sigmas",
                      F.when(F.col("holdout_mae").isNull(), "insufficient_data").otherwise("trained").alias("status"))


def champions(versions: DataFrame, series_cols=()) -> DataFrame:
    return versions.where("alias = 'champion'")


def train_job(spark: SparkSession, agg_path: str, gran: str, as_of, root: str, series_cols=(),
              trees: int = GBT_TREES, leaves: int = GBT_LEAVES, min_improvement: float = 0.0, only: DataFrame | None = None) -> DataFrame:
    """Train the panel model on data up to ``as_of``; evaluate, decide on promotion
    per series, save the model under ``root`` and rewrite the version table there.
    ``only`` (rows of series keys, as ``monitor_job`` leaves them) limits which series
    get a new version. Returns the version table; running it again changes nothing."""
    keys = list(series_cols)
    gran = gran.upper()
    d = ingest.bound_as_of(spark.read.parquet(agg_path), as_of)
    quality.assert_quality(d, 1, keys)
    split = feat.holdout_split(feat.training_frame(d, gran, keys), gran, keys).checkpoint()
    version = f"{gran}-{str(as_of).replace(' ', 'T').replace(':', '')}"
    path = f"{root}/models/{version}"
    found = evaluate(split, gran, keys, trees, leaves)
    if only is not None:
        found = join_on(found, only.select(*keys), keys, "left_semi") if keys else found
    model.fit_gbt(split, feat.feature_columns(gran), keys, trees=trees, leaves=leaves).save(path)
    found = found.select(*keys, F.lit(gran).alias("granularity"), F.lit(version).alias("version"), "n_rows", "holdout_mae",
                         "garch_sigma", "hour_sigmas", "status", F.lit(str(as_of)).cast("timestamp").alias("trained_as_of"),
                         F.lit(path).alias("path")).checkpoint()
    table = f"{root}/versions"
    old = sinks.read_snapshot(spark, table)
    key = [*keys, "granularity"]
    if old is None:
        old = spark.createDataFrame([], found.withColumn("alias", F.lit("")).schema)
    old = old.where(F.col("version") != version).checkpoint()
    incumbent = old.where("alias = 'champion'").select(*key, F.col("version").alias("champion_version"), F.col("holdout_mae").alias("champion_mae"))
    decided = promotion.promotion_decision(found, incumbent, key, min_improvement)
    merged = promotion.next_model_versions(old, decided, key).checkpoint()
    return sinks.write_snapshot(spark, merged, table)


def infer_job(spark: SparkSession, agg_path: str, gran: str, as_of, root: str, log_path: str,
              series_cols=(), confidence: float = 0.99) -> DataFrame:
    """Forecast the period after each series' last one up to ``as_of`` with its
    champion and upsert it into the log. Bad input stops the job before a forecast is
    made. A series without a champion or too short for the model gets the
    seasonal-naive point, and the fixed sigma where there is none of its own."""
    keys = list(series_cols)
    d = feat.latest_periods(ingest.bound_as_of(spark.read.parquet(agg_path), as_of), RECENT_WINDOW, keys)
    quality.assert_quality(d, 1, keys)
    nxt = feat.next_step_features(d, gran, keys)
    versions = sinks.read_snapshot(spark, f"{root}/versions")
    inputs = feat.feature_columns(gran)
    if versions is None:
        pred = nxt.withColumn("prediction", F.lit(None).cast("double")).withColumn("version", F.lit(None).cast("string"))
        pred = pred.withColumn("garch_sigma", F.lit(None).cast("double")).withColumn("hour_sigmas", F.lit(None).cast("string"))
    else:
        top = champions(versions).where(F.col("granularity") == gran.upper()).select(*keys, "version", "path", "garch_sigma", "hour_sigmas")
        served = attach(nxt, top, keys, how="left").checkpoint()
        parts = [served.where("path is null").withColumn("prediction", F.lit(None).cast("double"))]
        for r in top.select("path").distinct().collect():  # as many as versions that are champion of some series
            fitted = model.PanelModel.load(spark, r["path"], inputs, keys)
            parts.append(fitted.predict(served.where(F.col("path") == r["path"])))
        pred = parts[0]
        for p in parts[1:]:
            pred = pred.unionByName(p)
    point = F.coalesce("prediction", "LagS")
    named = pred.withColumn("point", point).withColumn(
        "status", F.when(F.col("prediction").isNotNull(), "model").when(F.col("LagS").isNotNull(), "naive").otherwise("insufficient_data"))
    by_hour = F.from_json("hour_sigmas", "map<string,double>")
    sigma = F.coalesce(F.element_at(by_hour, F.hour(F.col("TimePeriod").cast("timestamp_ntz")).cast("string")), F.col("garch_sigma"))
    x = named.withColumn("sigma", sigma).withColumn("sigma", risk.sigma_or_fixed("sigma", gran))
    rows = x.select(*keys, "TimePeriod", F.lit(str(as_of)).cast("timestamp").alias("Inferred_At"),
                    *band_columns(F.col("point"), F.col("sigma"), confidence), "version", "status").checkpoint()
    sinks.upsert_log(spark, rows, log_path, [*keys, "TimePeriod"])
    return rows


def monitor_job(spark: SparkSession, log_path: str, agg_path: str, root: str, gran: str, series_cols=()) -> DataFrame:
    """Score matured forecasts against the champion's holdout error and flag concept
    drift per series; the flagged ones are what ``train_job(only=...)`` takes."""
    keys = list(series_cols)
    empty = ", ".join([*(f"{k} string" for k in keys), "n_matured long", "drift_detected boolean"])
    versions = sinks.read_snapshot(spark, f"{root}/versions")
    if versions is None or not files.path_exists(spark, log_path) or not files.path_exists(spark, agg_path):
        return spark.createDataFrame([], empty)
    top = champions(versions).where(F.col("granularity") == gran.upper())
    base = top.select(*keys, F.when(F.col("holdout_mae") < float("inf"), F.col("holdout_mae")).alias("baseline_mae"))
    summary = monitoring.score_forecasts(spark.read.parquet(log_path), spark.read.parquet(agg_path), keys)
    return monitoring.concept_drift(summary, base, keys)


def drift_job(spark: SparkSession, current: DataFrame, columns, baseline_path: str) -> DataFrame:
    """Data drift of ``current`` against the stored baseline; the first run stores it."""
    counts = monitoring.value_counts(current, columns)
    stored = sinks.read_table_or_none(spark, baseline_path)
    if stored is None:
        sinks.write_aggregate(counts, baseline_path)
        stored = spark.read.parquet(baseline_path)
    return monitoring.drift_of_counts(stored, counts, columns)


@dataclass(frozen=True)
class Task:
    """A named step: what it runs and the settings it cannot do without."""

    run: Callable
    needs: tuple[str, ...]

    def __call__(self, spark: SparkSession, settings: dict):
        missing = [n for n in self.needs if n not in settings]
        if missing:
            raise TypeError(f"settings missing: {', '.join(missing)}")
        return self.run(spark, settings)


def _table(settings: dict, gran: str) -> str:
    return f"{settings['out_root']}/{'daily' if gran == 'D' else 'hourly'}"


def _given(settings: dict, *names) -> dict:
    return {n: settings[n] for n in names if n in settings}


def _steps(gran: str, word: str) -> dict[str, Task]:
    at = ("out_root", "as_of", "root")

    def check(spark, s):
        return validate_job(spark, _table(s, gran), **_given(s, "min_rows", "series_cols"))

    def train(spark, s):
        return train_job(spark, _table(s, gran), gran, s["as_of"], s["root"], **_given(s, "series_cols", "trees", "leaves", "only"))

    def infer(spark, s):
        return infer_job(spark, _table(s, gran), gran, s["as_of"], s["root"], s["log_path"], **_given(s, "series_cols", "confidence"))

    def watch(spark, s):
        return monitor_job(spark, s["log_path"], _table(s, gran), s["root"], gran, **_given(s, "series_cols"))

    return {f"validate-{word}": Task(check, ("out_root",)), f"train-{word}": Task(train, at),
            f"{word}-inference": Task(infer, (*at, "log_path")), f"monitor-{word}": Task(watch, ("out_root", "root", "log_path"))}


TASKS: dict[str, Task] = {
    "ingest": Task(lambda spark, s: ingest_job(spark, s["source"], s["out_root"], s["as_of"], **_given(s, "ts_col", "series_cols", "source_tz")),
                   ("source", "out_root", "as_of")),
    **_steps("D", "daily"), **_steps("H", "hourly"),
}


def run_task(name: str, spark: SparkSession, **settings):
    """Run one step of the chain by name."""
    try:
        task = TASKS[name]
    except KeyError:
        raise ValueError(f"no task {name!r}; there are {', '.join(TASKS)}") from None
    return task(spark, settings)
