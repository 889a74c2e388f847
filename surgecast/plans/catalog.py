"""Query plans over the driver's tables.

Mapping of the test tables onto the demand model:
* ``events.ts``: raw event times; ``event_type`` is the series key of the hourly panel;
* ``orders.o_orderdate``: a long daily series (and a panel by ``o_orderpriority``);
* ``lineitem.l_shipdate``: a second long daily series;
* ``documents`` / ``customer``: text for the PII scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import FEATURE_VIEW_FIELDS, GBT_NOWCAST_MIN_INSTANCES, GBT_NOWCAST_TREES, granularity
from ..functions.risk import band_columns, clip0
from ..operators import audit, features as feat, ingest, model, monitoring, pii, promotion, quality, risk
from ..operators.common import attach, join_on
from ..sources import files, online, sinks
from ..streaming import incremental
from ..session import ensure_checkpoint_dir, scratch_path
from . import jobs, refresh
from .tidy import tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Series definitions: (table, time column, series key, granularity)
EVENTS_PANEL = ("events", "ts", ("event_type",), "H")
EVENTS_TOTAL = ("events", "ts", (), "H")
ORDERS_DAILY = ("orders", "o_orderdate", (), "D")
ORDERS_PANEL = ("orders", "o_orderdate", ("o_orderpriority",), "D")
LINEITEM_DAILY = ("lineitem", "l_shipdate", (), "D")


# Lower time bound per table: the 2009 cleaning bound for event data, the
# TPC-H calendar start for the order tables.
MIN_TS = {"orders": "1992-01-01 00:00:00", "lineitem": "1992-01-01 00:00:00"}


#: The latest time an event of the test tables may have (jobs get theirs per run).
AS_OF = "2030-01-01 00:00:00"


def clean(spark, sf_dir, name, ts, keep=(), as_of=AS_OF) -> DataFrame:
    raw = table(spark, sf_dir, name)
    return ingest.clean_events(raw, ts, as_of=as_of, keep=list(keep),
                               min_ts=MIN_TS.get(name, "2009-01-01 00:00:00"))


def series(spark, sf_dir, spec, as_of=AS_OF) -> DataFrame:
    name, ts, keys, gran = spec
    clean_df = clean(spark, sf_dir, name, ts, keys, as_of)
    return ingest.demand(clean_df, ts, gran, list(keys))


def ingested(spark, sf_dir, spec) -> DataFrame:
    """The demand table as the ingest job leaves it: computed once from the raw
    events and checkpointed into the shared ``spark.checkpoint.dir`` (reliable,
    survives executor loss). Queries that read one series several times (split,
    next step, actuals) then scan the raw table once, not once per branch."""
    ensure_checkpoint_dir(spark)
    return series(spark, sf_dir, spec).checkpoint(eager=True)


def q_demand_hourly(spark, sf_dir):
    return tidy(series(spark, sf_dir, EVENTS_TOTAL))


def q_demand_daily(spark, sf_dir):
    hourly = ingest.demand(clean(spark, sf_dir, "lineitem", "l_shipdate"), "l_shipdate", "H")
    return tidy(ingest.rollup(hourly, "D"))


def q_demand_gapfilled(spark, sf_dir):
    return tidy(series(spark, sf_dir, EVENTS_PANEL))


def q_past_only_features(spark, sf_dir):
    d = series(spark, sf_dir, EVENTS_PANEL)
    return tidy(feat.past_only_features(d, "H", ["event_type"]))


def q_nowcast_features(spark, sf_dir):
    d = series(spark, sf_dir, ORDERS_DAILY)
    return tidy(feat.nowcast_features(d, "D"))


def q_ema_features(spark, sf_dir):
    d = series(spark, sf_dir, EVENTS_PANEL)
    return tidy(feat.ema_features(d, "H", ["event_type"]))




# ------------------------------------------------------------ scans and cleaning

def q_scan_raw(spark, sf_dir):
    return tidy(files.scan_raw(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type"))


# The tables' names carry no month. The orders are read as two runs of months that meet
# (each a half-open range), the end of the line items is open.
MONTHLY_SOURCES = (("orders", "o_orderdate", "1995-01", "1997-12"), ("orders", "o_orderdate", "1998-01", "2001-12"),
                   ("lineitem", "l_shipdate", "1995-01", None))


def q_monthly_union(spark, sf_dir):
    srcs = [(f"{sf_dir}/{t}.parquet", c, *months) for t, c, *months in MONTHLY_SOURCES]
    return tidy(files.monthly_union(spark, srcs))


def q_coerce_timestamps(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = ev.select("event_id", F.when(F.col("event_type") == "error", F.col("props"))
                    .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("stamp"))
    return tidy(ingest.clean_events(raw, "stamp", as_of=AS_OF, keep=["event_id"]))


def q_utc_normalize(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return tidy(ingest.clean_events(ev, "ts", source_tz="America/New_York", as_of=AS_OF, keep=["event_id"]))


RANGE_AS_OF = "2024-01-20 12:00:00"


def q_range_filter(spark, sf_dir):
    return tidy(clean(spark, sf_dir, "events", "ts", ["event_id"], as_of=RANGE_AS_OF))


def q_recent_window(spark, sf_dir):
    d = series(spark, sf_dir, ORDERS_DAILY)
    return tidy(ingest.recent_window(d, "2001-08-01 00:00:00", days=7))


def q_asof_recent60(spark, sf_dir):
    d = series(spark, sf_dir, ORDERS_PANEL)
    return tidy(feat.latest_periods(ingest.bound_as_of(d, "2000-06-30 00:00:00"), 60, ["o_orderpriority"]))


def q_rollup_consistency(spark, sf_dir):
    # one scan: hourly counts feed the rolled-up side, and their sums the direct one
    ev = clean(spark, sf_dir, "events", "ts", ["event_type"])
    counted = ingest.count_per_period(ev, "ts", "H", ["event_type"])
    hourly = ingest.demand_of_counts(counted, "H", ["event_type"])
    daily = ingest.demand_of_counts(ingest.coarser_counts(counted, "H", "D", ["event_type"]), "D", ["event_type"])
    return tidy(ingest.rollup_consistency(hourly, daily, ["event_type"]))


def q_data_profile(spark, sf_dir):
    return tidy(ingest.data_profile(series(spark, sf_dir, ORDERS_PANEL), ["o_orderpriority"]))


# ------------------------------------------------------------------- features

def q_lag_features(spark, sf_dir):
    return tidy(feat.lag_features(series(spark, sf_dir, ORDERS_DAILY), "D"))


def q_rolling_features(spark, sf_dir):
    return tidy(feat.rolling_features(series(spark, sf_dir, ORDERS_DAILY), "D"))


def q_cyclical_features(spark, sf_dir):
    return tidy(feat.cyclical_features(series(spark, sf_dir, EVENTS_TOTAL), "H"))


def q_training_frame(spark, sf_dir):
    return tidy(feat.training_frame(series(spark, sf_dir, ORDERS_DAILY), "D"))


def q_next_step_features(spark, sf_dir):
    return tidy(feat.next_step_features(series(spark, sf_dir, EVENTS_PANEL), "H", ["event_type"]))


def q_nowcast_latest(spark, sf_dir):
    f = feat.nowcast_features(series(spark, sf_dir, ORDERS_PANEL), "D", ["o_orderpriority"])
    return tidy(feat.latest_row(f, ["o_orderpriority"]))


def q_holdout_split(spark, sf_dir):
    tf = feat.training_frame(series(spark, sf_dir, ORDERS_DAILY), "D")
    return tidy(feat.holdout_split(tf, "D"))


def q_offline_features(spark, sf_dir):
    return tidy(feat.offline_features(series(spark, sf_dir, ORDERS_DAILY), "D"))


def q_feature_view_daily(spark, sf_dir):
    return tidy(feat.feature_view(feat.offline_features(series(spark, sf_dir, ORDERS_DAILY), "D"), "D"))


def q_feature_view_hourly(spark, sf_dir):
    """The hourly view, by way of the offline store: written there, read back."""
    f = feat.offline_features(series(spark, sf_dir, EVENTS_PANEL), "H", ["event_type"])
    path = scratch_path(spark, "offline-features")
    sinks.write_offline_features(f, path)
    stored = spark.read.parquet(path).where("granularity = 'H'")
    return tidy(feat.feature_view(stored, "H", ["event_type"]))


def q_null_key_features(spark, sf_dir):
    """Lags and averages of a panel in which one series has no name."""
    ev = table(spark, sf_dir, "events").select("ts", F.nullif("event_type", F.lit("signup")).alias("event_type"))
    d = ingest.demand(ingest.clean_events(ev, "ts", as_of=AS_OF, keep=["event_type"]), "ts", "H", ["event_type"])
    return tidy(feat.window_features(d, "H", ["event_type"], lags=(1,), rolling=(), spans=(12,), calendar=False, regime=False))


ONLINE_AS_OF = "2024-01-25 00:00:00"


def q_interval_refresh(spark, sf_dir):
    """Hourly features, built while a third of one day's events had not come, after that
    day was brought up to date."""
    ev, root = table(spark, sf_dir, "events"), scratch_path(spark, "refresh")
    day = ["2024-01-20 00:00:00", "2024-01-21 00:00:00"]
    missing = (F.col("ts") >= F.lit(day[0]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(day[1]).cast("timestamp_ntz")) & (F.col("event_id") % 3 == 0)
    kw = {"gran": "H", "ts_col": "ts", "series_cols": ["event_type"], "as_of": AS_OF}
    refresh.refresh(spark, ev.where(~missing), root, **kw)
    refresh.refresh(spark, ev, root, start=day[0], end=day[1], **kw)
    return tidy(spark.read.parquet(f"{root}/features").drop("month"))


def q_online_two_loads(spark, sf_dir):
    """The online table after two loads: at the first, the features of all entities but
    one end ten days before that one's."""
    f = feat.nowcast_features(ingested(spark, sf_dir, EVENTS_PANEL), "H", ["event_type"]).checkpoint()
    path = scratch_path(spark, "online")
    ahead = (F.col("event_type") == "click") | (F.col("TimePeriod") <= F.lit("2024-01-10 00:00:00").cast("timestamp"))
    online.materialize_incremental(spark, f.where(ahead), path, ["event_type"], "2024-01-20 00:00:00")
    online.materialize_incremental(spark, f, path, ["event_type"], ONLINE_AS_OF)
    return tidy(online.read_online(spark, path, ONLINE_AS_OF, granularity("H").ttl_us))


def q_online_latest(spark, sf_dir):
    f = feat.nowcast_features(series(spark, sf_dir, EVENTS_PANEL), "H", ["event_type"])
    return tidy(feat.online_latest(f, ONLINE_AS_OF, granularity("H").ttl_us, ["event_type"]))


# -------------------------------------------------------------- quality and PII

def q_quality_violations(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("TimePeriod"),
                                                F.col("value").alias("Volume"))
    return tidy(quality.quality_violations(ev, ["event_type"]))


def q_pii_scan(spark, sf_dir):
    return tidy(pii.pii_scan(table(spark, sf_dir, "documents")))


def q_pii_gate(spark, sf_dir):
    """What the output gate would stop: customers joined with a contact column."""
    contact = F.concat(F.lower("c_name"), F.lit("@example.com"))
    some = table(spark, sf_dir, "customer").withColumn("contact", F.when(F.col("c_custkey") % 7 == 0, contact))
    return tidy(pii.pii_scan(some))


def q_pii_redact(spark, sf_dir):
    clean_df, _ = pii.without_pii_columns(table(spark, sf_dir, "documents"))
    return tidy(clean_df)


# ------------------------------------------------- seasonal-naive backtests, risk

def naive_split(spark, sf_dir, spec, demand=None):
    _, _, keys, gran = spec
    d = demand if demand is not None else series(spark, sf_dir, spec)
    tf = feat.training_frame(d, gran, list(keys))
    return model.seasonal_naive(feat.holdout_split(tf, gran, list(keys)))


def naive_test_residuals(spark, sf_dir, spec, demand=None):
    sp = naive_split(spark, sf_dir, spec, demand)
    return model.residuals(sp.filter(F.col("role") == "test"), list(spec[2]))


def q_backtest_metrics(spark, sf_dir):
    sp = naive_split(spark, sf_dir, EVENTS_PANEL)
    return tidy(model.backtest_metrics(sp.filter(F.col("role") == "test"), ["event_type"]))


def q_backtest_metrics_garch(spark, sf_dir):
    """The backtest report with the band sigma from GARCH(1,1) on the holdout
    residuals (residual std as the fallback)."""
    ensure_checkpoint_dir(spark)
    tail = naive_split(spark, sf_dir, EVENTS_PANEL).filter(F.col("role") == "test").checkpoint()
    return tidy(found(model.backtest_metrics(tail, ["event_type"], sigma="garch"), "sigma"))


def all_residuals(spark, sf_dir, spec, demand=None):
    sp = naive_split(spark, sf_dir, spec, demand)
    return model.residuals(sp.filter(F.col("role") != "insufficient_data"), list(spec[2]))


def q_conditional_sigmas(spark, sf_dir):
    res = all_residuals(spark, sf_dir, EVENTS_PANEL)
    fb = risk.residual_sigma(res, ["event_type"])
    return tidy(risk.conditional_sigmas(res, fb, ["event_type"], fallback_col="resid_sigma"))


def q_var_buffer(spark, sf_dir):
    res = naive_test_residuals(spark, sf_dir, ORDERS_DAILY)
    sig = risk.residual_sigma(res)
    x = attach(res, sig)
    return tidy(x.select("TimePeriod", *band_columns(F.col("pred"), F.col("resid_sigma"), 0.99)))


def found(df: DataFrame, *cols: str) -> DataFrame:
    """What a search for a maximum finds, to 4 places."""
    return df.withColumns({c: F.round(c, 4) for c in cols})


def q_garch_sigma(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    res = naive_test_residuals(spark, sf_dir, EVENTS_PANEL).checkpoint()
    fb = risk.residual_sigma(res, ["event_type"])
    return tidy(found(risk.garch_sigma(res, ["event_type"], fallback=fb), "alpha", "beta", "omega", "loglik", "garch_sigma"))


def _versions(spark, sf_dir, demand=None):
    """Model-version rows per event type, as training leaves them: the GARCH sigma of
    the holdout residuals (their std, then the fixed sigma as fallback) and the
    per-hour sigma JSON tag from the same residuals. Computed once."""
    keys = ["event_type"]
    res = naive_test_residuals(spark, sf_dir, EVENTS_PANEL, demand).checkpoint()
    g = risk.garch_sigma(res, keys, fallback=risk.residual_sigma(res, keys))
    g = g.select(*keys, risk.sigma_or_fixed("garch_sigma", "H").alias("garch_sigma")).checkpoint()
    hs = risk.hour_sigma_json(risk.conditional_sigmas(res, g, keys, fallback_col="garch_sigma", min_count=HOUR_MIN), keys)
    return attach(g, hs, keys, "left").checkpoint()


#: The reference's floor is 20 values an hour, which ``conditional_sigmas`` keeps; the held-out
#: tail of these 30 days has five or six, so here six let an hour have its own sigma.
HOUR_MIN = 6


def _next_naive(spark, sf_dir):
    d = ingested(spark, sf_dir, EVENTS_PANEL)
    nxt = feat.next_step_features(d, "H", ["event_type"]).select("event_type", "TimePeriod", F.col("LagS").alias("point"))
    return risk.hour_sigma_lookup(nxt, _versions(spark, sf_dir, d), ["event_type"])


def q_hour_sigma_lookup(spark, sf_dir):
    return tidy(found(_next_naive(spark, sf_dir).select("event_type", "TimePeriod", "sigma"), "sigma"))


def q_next_forecast_naive(spark, sf_dir):
    return tidy(risk.var_band(_next_naive(spark, sf_dir), "point", "sigma"))


# --------------------------------------------------------------------- GBT (R)

def _panel_split(spark, sf_dir):
    """The hourly panel with its split, computed once for fit and evaluation."""
    ensure_checkpoint_dir(spark)
    return naive_split(spark, sf_dir, EVENTS_PANEL).drop("prediction").checkpoint()


def q_gbt_forecast(spark, sf_dir):
    """The trees against the seasonal-naive forecast on the same held-out tail: every
    prediction, and both errors per series."""
    keys = ["event_type"]
    tail = model.gbt_holdout(_panel_split(spark, sf_dir), feat.feature_columns("H"), keys).checkpoint()
    both = attach(tail, model.versus_naive(tail, keys).drop("n"), keys)
    return tidy(both.select(*keys, "TimePeriod", "y", "prediction", F.col("LagS").alias("naive"), "model_mae", "naive_mae", "beats_naive"))


def q_gbt_nowcast(spark, sf_dir):
    """Nowcast of the latest day with the sigma of the model's own held-out tail."""
    ensure_checkpoint_dir(spark)
    f = feat.nowcast_features(series(spark, sf_dir, ORDERS_DAILY), "D").withColumn("y", F.col("Volume").cast("double"))
    split = feat.holdout_split(f, "D").checkpoint()
    cols, kw = list(FEATURE_VIEW_FIELDS["D"]), {"trees": GBT_NOWCAST_TREES, "min_instances": GBT_NOWCAST_MIN_INSTANCES}
    res = model.residuals(model.gbt_holdout(split, cols, **kw), clip=False).checkpoint()
    sig = risk.garch_sigma(res, fallback=risk.residual_sigma(res)).select(risk.sigma_or_fixed("garch_sigma", "D").alias("sigma"))
    now = model.fit_gbt(split, cols, **kw).predict(feat.latest_row(split))
    return tidy(risk.var_band(attach(now.select("TimePeriod", F.col("prediction").alias("point")), sig), "point", "sigma"))


def q_next_forecast(spark, sf_dir):
    """Next hour by the trees, with the sigmas of their own held-out tail."""
    keys = ["event_type"]
    d = ingested(spark, sf_dir, EVENTS_PANEL)
    split = naive_split(spark, sf_dir, EVENTS_PANEL, d).drop("prediction").checkpoint()
    versions = jobs.evaluate(split, "H", keys).select(*keys, "garch_sigma", "hour_sigmas").checkpoint()
    pred = model.fit_gbt(split, feat.feature_columns("H"), keys).predict(feat.next_step_features(d, "H", keys))
    x = risk.hour_sigma_lookup(pred.select(*keys, "TimePeriod", F.col("prediction").alias("point")), versions, keys)
    return tidy(risk.var_band(x, "point", "sigma"))


# ------------------------------------------------------ promotion and monitoring

def _model_mae(spark, sf_dir, spec, role, pred_col, demand=None):
    keys = list(spec[2])
    sp = naive_split(spark, sf_dir, spec, demand).filter(F.col("role") == role)
    err = F.abs(F.col("y") - clip0(F.col(pred_col)))
    return sp.groupBy(*keys).agg(F.avg(err).alias("mae"))


def _candidates(spark, sf_dir):
    d = ingested(spark, sf_dir, EVENTS_PANEL)
    ev = _model_mae(spark, sf_dir, EVENTS_PANEL, "test", "LagS", d)
    od = _model_mae(spark, sf_dir, ORDERS_PANEL, "test", "LagS")
    cands = (ev.select(F.concat(F.lit("events:"), "event_type").alias("model"), "mae")
             .unionByName(od.select(F.concat(F.lit("orders:"), "o_orderpriority").alias("model"), "mae"))
             .select("model", F.lit("v2").alias("version"), F.col("mae").alias("holdout_mae")))
    champs = _model_mae(spark, sf_dir, EVENTS_PANEL, "test", "Lag1", d).select(
        F.concat(F.lit("events:"), "event_type").alias("model"), F.lit("v1").alias("champion_version"),
        F.round("mae", 6).alias("champion_mae"))
    return cands, champs


def q_promotion_decision(spark, sf_dir):
    cands, champs = _candidates(spark, sf_dir)
    return tidy(promotion.promotion_decision(cands, champs, ["model"]))


def q_model_versions(spark, sf_dir):
    """The version table after the decision: champions step back or stay."""
    cands, champs = _candidates(spark, sf_dir)
    before = champs.select("model", F.col("champion_version").alias("version"), F.col("champion_mae").alias("holdout_mae"),
                           F.lit("champion").alias("alias"))
    return tidy(promotion.next_model_versions(before, promotion.promotion_decision(cands, champs, ["model"]), ["model"]))


def shadow_log(spark, sf_dir, spec=EVENTS_PANEL, demand=None):
    """Forecast log rows: seasonal-naive point and 99% band for every test period
    plus the next period, per series."""
    keys = list(spec[2])
    demand = demand if demand is not None else series(spark, sf_dir, spec)
    res = naive_test_residuals(spark, sf_dir, spec, demand)
    sig = risk.residual_sigma(res, keys)
    test = attach(res, sig, keys).select(*keys, "TimePeriod", F.col("pred").alias("point"),
                                         F.col("resid_sigma").alias("sigma"))
    nxt = feat.next_step_features(demand, spec[3], keys)
    nxt = attach(nxt.select(*keys, "TimePeriod", F.col("LagS").alias("point")),
                 sig.select(*keys, F.col("resid_sigma").alias("sigma")), keys, how="left")
    nxt = nxt.withColumn("sigma", risk.sigma_or_fixed("sigma", spec[3]))
    return risk.var_band(test.unionByName(nxt), "point", "sigma")


def q_score_forecasts(spark, sf_dir):
    d = ingested(spark, sf_dir, EVENTS_PANEL)
    return tidy(monitoring.score_forecasts(shadow_log(spark, sf_dir, EVENTS_PANEL, d), d, ["event_type"]))


#: Demand of two event types doubles from here on: the drift that the monitor must see.
SHIFT_AT = "2024-01-26 00:00:00"
SHIFTED = ("click", "error")


def _drift(spark, sf_dir):
    """Forecasts made before a shift in demand, scored on what came: the shift of
    ``SHIFTED`` is drift, the rest is not."""
    d = ingested(spark, sf_dir, EVENTS_PANEL)
    shifted = F.col("event_type").isin(*SHIFTED) & (F.col("TimePeriod") >= F.lit(SHIFT_AT).cast("timestamp"))
    came = d.withColumn("Volume", F.when(shifted, F.col("Volume") * 2 + 5).otherwise(F.col("Volume")))
    summary = monitoring.score_forecasts(shadow_log(spark, sf_dir, EVENTS_PANEL, d), came, ["event_type"])
    base = _model_mae(spark, sf_dir, EVENTS_PANEL, "train", "LagS", d).select(
        "event_type", F.round("mae", 6).alias("baseline_mae"))
    return monitoring.concept_drift(summary, base, ["event_type"])


def q_concept_drift(spark, sf_dir):
    return tidy(_drift(spark, sf_dir))


def q_retrain_set(spark, sf_dir):
    return tidy(monitoring.retrain_set(_drift(spark, sf_dir), ["event_type"]))


def q_mae_degradation(spark, sf_dir):
    sp = naive_split(spark, sf_dir, EVENTS_PANEL).filter(F.col("role") != "insufficient_data")
    errs = sp.select("event_type", F.when(F.col("role") == "train", "reference").otherwise("current").alias("window"),
                     F.abs(F.col("y") - clip0(F.col("prediction"))).alias("abs_err"))
    return tidy(monitoring.mae_degradation(errs, ["event_type"]))


DRIFT_SPLIT = "2024-01-24 00:00:00"
DRIFT_COLUMNS = ("value", "user_id", "event_id", "event_type")


def q_data_drift(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cut = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    return tidy(monitoring.data_drift(ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut), DRIFT_COLUMNS))


def q_drift_by_size(spark, sf_dir):
    """The tests for samples of this size, and those for small ones on the same columns."""
    ev = table(spark, sf_dir, "events")
    cut = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    sides = ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)
    large = monitoring.drift_by_size(*sides, DRIFT_COLUMNS, small=0)
    return tidy(large.unionByName(monitoring.drift_by_size(*sides, DRIFT_COLUMNS, small=2**62)))


def q_drift_summary(spark, sf_dir):
    """Data drift and error growth in one row, as a monitoring run stores it."""
    sp = naive_split(spark, sf_dir, EVENTS_PANEL).filter(F.col("role") != "insufficient_data")
    errs = sp.select(F.when(F.col("role") == "train", "reference").otherwise("current").alias("window"),
                     F.abs(F.col("y") - clip0(F.col("prediction"))).alias("abs_err"))
    ev = table(spark, sf_dir, "events")
    cut = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    drift = monitoring.data_drift(ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut), DRIFT_COLUMNS)
    return tidy(monitoring.drift_summary(drift, monitoring.mae_degradation(errs)))


# ----------------------------------------------------------------- log upserts

UPSERT_AS_OF = "2000-01-01 00:00:00"


def q_shadow_upsert(spark, sf_dir):
    res = naive_split(spark, sf_dir, ORDERS_DAILY).filter(F.col("role") == "test")
    as_of = F.lit(UPSERT_AS_OF).cast("timestamp")
    existing = res.filter(F.col("TimePeriod") <= as_of).select(
        "TimePeriod", F.lit(UPSERT_AS_OF).cast("timestamp").alias("Inferred_At"),
        F.round(clip0(F.col("Lag1")), 2).alias("Point_Forecast"))
    new = res.filter(F.col("TimePeriod") > as_of - F.expr("INTERVAL 30 DAYS")).select(
        "TimePeriod", F.lit("2000-02-01 00:00:00").cast("timestamp").alias("Inferred_At"),
        F.round(clip0(F.col("LagS")), 2).alias("Point_Forecast"))
    return tidy(sinks.upsert_merge(existing, new, ["TimePeriod"]))


# ---------------------------------------------------------------- requests/audit

def requests(spark, sf_dir):
    """Requests derived from events: one request per event, client = user_id."""
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(
        "event_id", "user_id", "ts",
        "CASE WHEN event_type = 'error' THEN props "
        "ELSE concat(CAST(CAST(ts AS DATE) AS STRING), 'T', lpad(CAST(hour(ts) AS STRING), 2, '0')) END AS time_period",
        "CASE event_type WHEN 'view' THEN 'd' WHEN 'click' THEN 'H' WHEN 'purchase' THEN 'D' "
        "WHEN 'signup' THEN 'DROP' ELSE 'h' END AS granularity",
        "value / 100.0 AS confidence_level",
        "value * 1000.0 AS point_forecast",
        "value / 1000.0 AS latency_s")


def q_request_validation(spark, sf_dir):
    v = audit.request_validation(requests(spark, sf_dir))
    return tidy(v.select("event_id", "granularity_norm", "valid", "reject_reason"))


def q_request_audit(spark, sf_dir):
    out = audit.request_outcomes(audit.request_validation(requests(spark, sf_dir)))
    return tidy(audit.request_audit(out))


def q_latency_p99(spark, sf_dir):
    v = audit.request_validation(requests(spark, sf_dir)).withColumn(
        "granularity", F.coalesce(F.col("granularity_norm"), F.lit("invalid")))
    return tidy(audit.latency_quantile(v, 0.99, "latency_s", ["granularity"]))


def q_latency_p99_windowed(spark, sf_dir):
    v = audit.request_validation(requests(spark, sf_dir)).withColumn(
        "granularity", F.coalesce(F.col("granularity_norm"), F.lit("invalid")))
    return tidy(audit.windowed_quantile(v, 0.99, "latency_s", "ts", ["granularity"]).withColumnRenamed("value", "p99"))


def q_latency_histogram(spark, sf_dir):
    v = audit.request_validation(requests(spark, sf_dir)).withColumn(
        "granularity", F.coalesce(F.col("granularity_norm"), F.lit("invalid")))
    return tidy(audit.latency_histogram(v, "latency_s", ["granularity"]))


def q_artifact_manifest(spark, sf_dir):
    return tidy(audit.artifact_hashes(spark, f"{sf_dir}/*.parquet").drop("path"))


def q_artifact_check(spark, sf_dir):
    """The tables' files against a manifest with a wrong hash, a file that is gone
    and one that is not listed."""
    hashes = audit.artifact_hashes(spark, f"{sf_dir}/*.parquet").select("file", "sha256")
    wrong = F.when(F.col("file") == "part.parquet", F.lit("0" * 64)).otherwise(F.col("sha256"))
    listed = hashes.where("file <> 'nation.parquet'").select("file", wrong.alias("expected_sha256"))
    gone = spark.createDataFrame([("gone.parquet", "f" * 64)], "file string, expected_sha256 string")
    return tidy(audit.verify_artifacts(hashes, listed.unionByName(gone)).select("file", "status"))


# ------------------------------------------------------------------- streaming

STREAM_SLICES = 4


def _sliced(spark, sf_dir) -> DataFrame:
    """The events with ``slice``: which quarter of their time they lie in."""
    ev = table(spark, sf_dir, "events")
    lo, hi = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    step = (hi - lo) // STREAM_SLICES + 1 if hi is not None else 1
    return ev.withColumn("slice", F.coalesce(F.floor((at - F.lit(lo)) / F.lit(step)), F.lit(0)).cast("int"))


def _arrivals(spark, sf_dir) -> str:
    """The events as a folder of files of one stretch of time each: the stream reads it
    in several micro-batches."""
    path = scratch_path(spark, "arrivals")
    _sliced(spark, sf_dir).repartition("slice").write.partitionBy("slice").parquet(path)
    return path


def _in_turn(spark, sf_dir, run) -> None:
    """``run(path)`` after each slice of events has arrived in the folder ``path``; every
    tenth event comes a slice late."""
    path, stage = scratch_path(spark, "arrivals"), scratch_path(spark, "arriving")
    come = F.least(F.col("slice") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.lit(STREAM_SLICES - 1))
    _sliced(spark, sf_dir).withColumn("come", come).drop("slice").write.partitionBy("come").parquet(stage)
    for i in range(STREAM_SLICES):
        if files.path_exists(spark, f"{stage}/come={i}"):
            spark.read.parquet(f"{stage}/come={i}").write.mode("append").parquet(path)
            run(path)


def q_stream_late(spark, sf_dir):
    """Hourly counts with late events, and how many came behind the watermark."""
    root = scratch_path(spark, "counted")
    _in_turn(spark, sf_dir, lambda path: incremental.run_counted_stream(spark, path, "ts", ["event_type"], root))
    keys = ["event_type", "TimePeriod"]
    late = spark.read.parquet(f"{root}/contributions").groupBy(*keys).agg(F.sum("n_late").alias("n_late"))
    return tidy(join_on(spark.read.parquet(f"{root}/hourly").drop("month"), late, keys, "left"))


def q_stream_hourly(spark, sf_dir):
    out = incremental.run_hourly_stream(spark, _arrivals(spark, sf_dir), "ts", ["event_type"], watermark="30 days", max_files=1)
    return tidy(spark.read.parquet(out).drop("month"))


def _latest_event(batch):
    # of events of one time the one of the highest id
    agg = batch.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_type", "value"), F.struct("ts", "event_id")).alias("r"))
    return agg.select("user_id", F.col("r.ts").cast("timestamp").alias("TimePeriod"),
                      F.col("r.event_type").alias("event_type"), F.col("r.value").alias("value"))


def q_stream_upsert(spark, sf_dir):
    out = incremental.run_upsert_stream(spark, _arrivals(spark, sf_dir), _latest_event, ["user_id"],
                                        partition_col=None, max_files=1)
    return tidy(spark.read.parquet(out).drop("key_bucket"))


def q_rate_breaches(spark, sf_dir):
    return tidy(incremental.rate_breaches(table(spark, sf_dir, "events"), "user_id", "ts", limit=1))


def q_stream_rate_breaches(spark, sf_dir):
    out = incremental.run_rate_breach_stream(spark, _arrivals(spark, sf_dir), "user_id", "ts", limit=1, watermark="30 days", max_files=1)
    return tidy(spark.read.parquet(out).drop("month"))


# ----------------------------------------------------------------- flagship

def q_capacity_plan(spark, sf_dir):
    """Expected demand and 99% capacity for every hour of every event type,
    from past-only features (seasonal-naive point, residual-std band)."""
    keys = ["event_type"]
    sp = naive_split(spark, sf_dir, EVENTS_PANEL)
    res = model.residuals(sp.filter(F.col("role") == "train"), keys)
    sig = risk.residual_sigma(res, keys)
    # a series too short to train on stays, with the fixed sigma
    x = attach(sp, sig, keys, how="left").select(*keys, "TimePeriod", "y", F.col("prediction").alias("point"),
                                                 risk.sigma_or_fixed("resid_sigma", "H").alias("sigma"))
    return tidy(risk.var_band(x, "point", "sigma"))


QUERIES = {
    "scan_raw": q_scan_raw,
    "monthly_union": q_monthly_union,
    "coerce_timestamps": q_coerce_timestamps,
    "utc_normalize": q_utc_normalize,
    "range_filter": q_range_filter,
    "recent_window": q_recent_window,
    "asof_recent60": q_asof_recent60,
    "demand_hourly": q_demand_hourly,
    "demand_daily": q_demand_daily,
    "demand_gapfilled": q_demand_gapfilled,
    "rollup_consistency": q_rollup_consistency,
    "data_profile": q_data_profile,
    "lag_features": q_lag_features,
    "rolling_features": q_rolling_features,
    "ema_features": q_ema_features,
    "cyclical_features": q_cyclical_features,
    "past_only_features": q_past_only_features,
    "training_frame": q_training_frame,
    "next_step_features": q_next_step_features,
    "nowcast_features": q_nowcast_features,
    "nowcast_latest": q_nowcast_latest,
    "holdout_split": q_holdout_split,
    "offline_features": q_offline_features,
    "feature_view_daily": q_feature_view_daily,
    "feature_view_hourly": q_feature_view_hourly,
    "null_key_features": q_null_key_features,
    "online_latest": q_online_latest,
    "online_two_loads": q_online_two_loads,
    "interval_refresh": q_interval_refresh,
    "quality_violations": q_quality_violations,
    "pii_scan": q_pii_scan,
    "pii_gate": q_pii_gate,
    "pii_redact": q_pii_redact,
    "backtest_metrics": q_backtest_metrics,
    "backtest_metrics_garch": q_backtest_metrics_garch,
    "conditional_sigmas": q_conditional_sigmas,
    "var_buffer": q_var_buffer,
    "garch_sigma": q_garch_sigma,
    "hour_sigma_lookup": q_hour_sigma_lookup,
    "next_forecast_naive": q_next_forecast_naive,
    "gbt_forecast": q_gbt_forecast,
    "gbt_nowcast": q_gbt_nowcast,
    "next_forecast": q_next_forecast,
    "promotion_decision": q_promotion_decision,
    "model_versions": q_model_versions,
    "score_forecasts": q_score_forecasts,
    "concept_drift": q_concept_drift,
    "retrain_set": q_retrain_set,
    "mae_degradation": q_mae_degradation,
    "data_drift": q_data_drift,
    "drift_by_size": q_drift_by_size,
    "drift_summary": q_drift_summary,
    "shadow_upsert": q_shadow_upsert,
    "request_validation": q_request_validation,
    "request_audit": q_request_audit,
    "latency_p99": q_latency_p99,
    "latency_p99_windowed": q_latency_p99_windowed,
    "latency_histogram": q_latency_histogram,
    "artifact_manifest": q_artifact_manifest,
    "artifact_check": q_artifact_check,
    "stream_hourly": q_stream_hourly,
    "stream_late": q_stream_late,
    "stream_upsert": q_stream_upsert,
    "rate_breaches": q_rate_breaches,
    "stream_rate_breaches": q_stream_rate_breaches,
    "capacity_plan": q_capacity_plan,
}
