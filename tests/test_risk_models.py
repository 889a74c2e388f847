import numpy as np
import pyspark.sql.functions as F
import pytest

from surgecast.functions.risk import standard_quantile
from surgecast.operators import model, promotion, risk


@pytest.mark.parametrize("point,sigma,want", [(100.0, 20.0, 100 + 20 * 2.3), (0.0, 5.0, 5 * 2.3), (-5.0, 1.0, 2.3), (50.0, 0.0, 50.0)])
def test_var_worked_by_hand(spark, point, sigma, want):
    """99 of 100 normal draws lie below 2.33 sigmas; the fixed draws' own quantile is near."""
    from surgecast.functions.risk import var_expr

    df = spark.createDataFrame([(point, sigma)], "point double, sigma double")
    got = df.select(var_expr(F.col("point"), F.col("sigma"), 0.99).alias("v")).first().v
    assert got == pytest.approx(want, abs=0.1 * sigma + 1e-6)
    assert abs(standard_quantile(0.99) - 2.326) < 0.1 and abs(standard_quantile(0.5)) < 0.05


def test_missing_point_or_sigma_has_no_band(spark):
    df = spark.createDataFrame([(None, 1.0), (10.0, None)], "point double, sigma double")
    rows = risk.var_band(df, "point", "sigma").collect()
    assert rows[0].Point_Forecast is None and rows[0].Safety_Buffer_99 is None and rows[0].Capacity_Target is None
    assert rows[1].Point_Forecast == 10.0 and rows[1].Safety_Buffer_99 is None


def test_band_rounding_and_monotone(spark):
    df = spark.createDataFrame([(117.4, 12.3), (-3.0, 2.0)], "point double, sigma double")
    rows = risk.var_band(df, "point", "sigma").collect()
    for r in rows:
        assert r.Safety_Buffer_99 >= r.Point_Forecast >= 0
        assert r.Capacity_Target >= r.Safety_Buffer_99
    assert standard_quantile(0.95) < standard_quantile(0.99)


def test_conditional_sigmas_floor_and_fallback(spark):
    rng = np.random.default_rng(42)
    rows = [(2, 0.0)] * 30 + [(9, float(x)) for x in rng.normal(0, 20, 30)] + [(5, 1.0), (5, 2.0), (5, 3.0)]
    import datetime as dt

    data = [(dt.datetime(2024, 1, 1, h) + dt.timedelta(days=i), r) for i, (h, r) in enumerate(rows)]
    df = spark.createDataFrame(data, "TimePeriod timestamp, resid double")
    fb = spark.createDataFrame([(7.0,)], "sigma double")
    out = {r.hour: r.hour_sigma for r in risk.conditional_sigmas(df, fb).collect()}
    assert out[2] == 0.5
    assert out[9] == pytest.approx(float(np.std([r for h, r in rows if h == 9])))
    assert out[5] == 7.0


def _likelihood(e, a, b, omega):
    start = float(np.mean(e * e))
    variance, squared, total = start, start, 0.0
    for x in e:
        variance = omega + a * squared + b * variance
        squared = x * x
        total += -0.5 * (np.log(variance) + squared / variance)
    return total


@pytest.mark.parametrize("a,b", [(0.15, 0.75), (0.7, 0.2), (0.05, 0.1)])
def test_garch_finds_what_a_finer_grid_finds(spark, a, b):
    import datetime as dt

    rng = np.random.default_rng(1)
    e, s2 = np.zeros(300), 1.0
    for t in range(300):
        s2 = 0.1 + a * (e[t - 1] ** 2 if t else 1.0) + b * s2
        e[t] = rng.normal() * np.sqrt(s2)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(300)]
    data = [("x", w, float(v)) for w, v in zip(at, e)] + [("short", w, 1.0 + i) for i, w in enumerate(at[:10])]
    data += [("flat", w, 0.0) for w in at[:50]] + [(None, w, float(v)) for w, v in zip(at, e)]
    df = spark.createDataFrame(data, "k string, TimePeriod timestamp, resid double")
    out = {r.k: r for r in risk.garch_sigma(df, ["k"], fallback=risk.residual_sigma(df, ["k"])).collect()}
    ed = e - e.mean()
    v0 = float(np.mean(ed * ed))
    best = max(_likelihood(ed, i, j, v0 * f * (1 - i - j)) for i in np.arange(0, 0.99, 0.03) for j in np.arange(0, 0.99, 0.03)
               for f in (0.6, 0.8, 1.0, 1.3, 1.7) if i + j < 0.99)
    assert out["x"].loglik >= best - 1e-6
    assert out["x"].sigma_source == "garch" and out["x"].garch_sigma > 0
    assert out[None].loglik == pytest.approx(out["x"].loglik)
    assert out["short"].sigma_source == "fallback"
    assert out["short"].garch_sigma == pytest.approx(float(np.std(np.arange(1.0, 11.0))))
    fixed = risk.garch_sigma(df, ["k"], fallback=risk.residual_sigma(df, ["k"])).select("k", risk.sigma_or_fixed("garch_sigma", "D").alias("s"))
    assert {r.k: r.s for r in fixed.collect()}["flat"] == 48.65


def _simplex(f, at, size=0.1, rounds=400):
    """Nelder and Mead's search for a minimum: no grid, no gradient."""
    pts = [np.array(at, float)] + [np.array(at, float) + size * np.eye(len(at))[i] for i in range(len(at))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        mid = np.mean(pts[:-1], axis=0)
        tries = [(k, mid + k * (mid - pts[-1])) for k in (1.0, 2.0, 0.5, -0.5)]
        got = [(f(p), p) for _, p in tries]
        best = min(got, key=lambda g: g[0])
        if best[0] < val[-1]:
            val[-1], pts[-1] = best
        else:
            pts = [pts[0]] + [(p + pts[0]) / 2 for p in pts[1:]]
            val = [val[0]] + [f(p) for p in pts[1:]]
    return min(val)


def _simulated(n, a, b, seed):
    rng = np.random.default_rng(seed)
    e, s2 = np.zeros(n), 1.0
    for t in range(n):
        s2 = 0.1 + a * (e[t - 1] ** 2 if t else 1.0) + b * s2
        e[t] = rng.normal() * np.sqrt(s2)
    return e


def test_garch_finds_what_a_free_search_finds(spark):
    import datetime as dt

    series = {f"{a} {b} {s}": _simulated(400, a, b, s) for a, b, s in ((0.1, 0.8, 1), (0.3, 0.5, 2), (0.05, 0.9, 3), (0.2, 0.0, 4))}
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(hours=i), float(v)) for k, e in series.items() for i, v in enumerate(e)]
    out = {r.w: r for r in risk.garch_sigma(spark.createDataFrame(rows, "w string, TimePeriod timestamp, resid double"), ["w"]).collect()}
    for k, e in series.items():
        ed = e - e.mean()
        v0 = float(np.mean(ed * ed))

        def loss(p, ed=ed, v0=v0):
            # next to alpha 0 the variance counts as constant
            return 1e9 if p[1] < 1e-3 or p[2] < 0 or p[0] <= 0 or p[1] + p[2] >= 0.9999 else -_likelihood(ed, p[1], p[2], p[0] * v0)

        free = min(_simplex(loss, start) for start in ([0.2, 0.1, 0.7], [0.5, 0.3, 0.2], [0.05, 0.05, 0.9]))
        assert out[k].loglik >= -free - 1e-6
        assert _likelihood(ed, out[k].alpha, out[k].beta, out[k].omega) == pytest.approx(out[k].loglik, abs=1e-6)


def test_garch_of_a_series_in_blocks(spark, monkeypatch):
    """Chained over three levels of blocks, as where it stands in one; the last variance
    worked by hand."""
    import datetime as dt

    from surgecast.operators import garch

    # one band of starts and a few steps: the two ways are compared, not the maximum
    monkeypatch.setattr(garch, "ALPHAS", ((0.05, 0.12, 0.3),))
    monkeypatch.setattr(garch, "BETAS", ((0.2, 0.4, 0.6),))
    monkeypatch.setattr(garch, "STEPS", 6)
    at = dt.datetime(2024, 1, 1)
    e = _simulated(150, 0.2, 0.6, 5)
    rows = [("long", at + dt.timedelta(hours=i), float(v)) for i, v in enumerate(e)]
    rows += [("short", at + dt.timedelta(hours=i), float(v)) for i, v in enumerate(e[:31])] + [(None, *r[1:]) for r in rows[:60]]
    df = spark.createDataFrame(rows, "k string, TimePeriod timestamp, resid double").repartition(3)
    whole = {r.k: r for r in risk.garch_sigma(df, ["k"]).collect()}
    monkeypatch.setattr(garch, "BLOCK", 5)
    cut = {r.k: r for r in risk.garch_sigma(df, ["k"]).collect()}
    assert set(cut) == set(whole) == {"long", "short", None}
    for k, r in whole.items():
        assert (r.n_resid, r.sigma_source) == (cut[k].n_resid, cut[k].sigma_source)
        for c in ("alpha", "beta", "omega", "loglik", "garch_sigma"):
            assert cut[k][c] == pytest.approx(r[c], abs=1e-5)
    ed, r = e - e.mean(), whole["long"]
    variance = squared = float(np.mean(ed * ed))
    for x in ed:
        variance = r.omega + r.alpha * squared + r.beta * variance
        squared = x * x
    assert r.garch_sigma == pytest.approx(np.sqrt(r.omega + r.alpha * squared + r.beta * variance), rel=1e-9)


def test_backtest_metrics_worked(spark):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1 + i), y, p) for i, (y, p) in enumerate([(10.0, 8.0), (0.0, -2.0), (20.0, 25.0)])]
    df = spark.createDataFrame(rows, "TimePeriod timestamp, y double, prediction double")
    m = model.backtest_metrics(df).first()
    resid = np.array([2.0, 0.0, -5.0])
    assert m.n == 3 and m.mae == pytest.approx(np.mean(np.abs(resid)))
    assert m.mape == pytest.approx(np.mean(np.abs(resid) / np.array([10.0, 1.0, 20.0])) * 100)
    assert m.sigma == pytest.approx(float(np.std(resid)))


def test_gbt_predicts_finite_and_keeps_short_rows(spark, daily_series):
    from surgecast.operators import features as feat

    _, df = daily_series
    tf = feat.training_frame(df, "D")
    m = model.fit_gbt(tf, feat.feature_columns("D"), trees=5, leaves=8, min_instances=2)
    holes = tf.withColumn("Lag1", F.when(F.col("TimePeriod") < "2024-01-12", None).otherwise(F.col("Lag1")))
    pred = m.predict(holes).collect()
    assert len(pred) == tf.count()
    assert all((r.prediction is None) == (r.Lag1 is None) for r in pred)


def test_gbt_panel_of_many_series(spark, tmp_path):
    """200 series, more than any bin count; a series the model has not seen is served."""
    rows = [(f"s{k}", float(k), float(k + d % 7)) for k in range(200) for d in range(20)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    m = model.fit_gbt(df, ["x"], ["k"], trees=4, leaves=8, min_instances=2)
    m.save(str(tmp_path / "m"))
    back = model.PanelModel.load(spark, str(tmp_path / "m"), ["x"], ["k"])
    new = spark.createDataFrame([("s7", 7.0), ("never", 8.0), (None, 9.0)], "k string, x double")
    got = {r.k: r.prediction for r in back.predict(new).collect()}
    assert set(got) == {"s7", "never", None} and all(np.isfinite(v) for v in got.values())


def test_not_finite_prediction_fails(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(float("nan"),)], "prediction double")
    with pytest.raises(PySparkException):
        df.select(model.finite("prediction")).collect()


@pytest.mark.parametrize("new,champ,margin,expected", [
    (15.0, None, 0.0, "champion"),     # no incumbent
    (15.0, 20.0, 0.0, "champion"),
    (25.0, 10.0, 0.0, "challenger"),
    (9.9, 10.0, 0.5, "challenger"),
    (float("inf"), 10.0, 0.0, "rejected"),
    (float("nan"), 10.0, 0.0, "rejected"),
    (None, 10.0, 0.0, "rejected"),
    (10.0000001, 10.0, 0.0, "champion"),  # rounded to 6 dp: tie wins
])
def test_promotion_branches(spark, new, champ, margin, expected):
    cands = spark.createDataFrame([("m", "v2", new)], "model string, version string, holdout_mae double")
    champs = spark.createDataFrame([] if champ is None else [("m", "v1", champ)],
                                   "model string, champion_version string, champion_mae double")
    d = promotion.promotion_decision(cands, champs, ["model"], margin).first()
    assert d.decision == expected
    assert d.promoted == (expected == "champion")


def test_champion_without_mae_counts_as_inf(spark):
    cands = spark.createDataFrame([("m", "v2", 50.0)], "model string, version string, holdout_mae double")
    champs = spark.createDataFrame([("m", "v1", None)], "model string, champion_version string, champion_mae double")
    assert promotion.promotion_decision(cands, champs, ["model"]).first().decision == "champion"
