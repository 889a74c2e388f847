import datetime as dt

import numpy as np
import pyspark.sql.functions as F
import pytest

from surgecast.operators import audit, monitoring, pii, quality
from surgecast.sources import sinks


def _demand(spark, vols):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(vols)]
    return spark.createDataFrame(rows, "TimePeriod timestamp, Volume double")


def test_valid_demand_passes(spark):
    q = quality.quality_violations(_demand(spark, [100, 200, 150, 175, 90]), min_rows=5).first()
    assert q.passed and q.invalid_rows == 0


@pytest.mark.parametrize("bad", [-5.0, float("nan"), float("inf"), 5_000_000.0])
def test_poisoned_rows_rejected(spark, bad):
    df = _demand(spark, [100.0, 200.0, bad, 175.0, 90.0])
    q = quality.quality_violations(df, min_rows=5).first()
    assert not q.passed and q.invalid_rows == 1
    with pytest.raises(quality.DataQualityError):
        quality.assert_quality(df, min_rows=5)


def test_zero_and_extra_columns_accepted(spark):
    df = _demand(spark, [0.0] * 40).withColumn("extra", F.lit("x"))
    assert quality.assert_quality(df) == 40


def test_min_rows_gate(spark):
    with pytest.raises(quality.DataQualityError):
        quality.assert_quality(_demand(spark, [1.0] * 5))


def test_pii_scan_redact_gate(spark):
    rows = [("mail me at jane.doe@example.com", "A-1", 1.0), ("ssn 123-45-6789 here", "B-2", 2.0),
            ("call (555) 123-4567 now", "2024-06-17", 3.0), ("card 4111 1111 1111 1111", None, 4.0)]
    df = spark.createDataFrame(rows, "note string, ref string, Volume double")
    rep = {(r.column, r.pattern): r.n for r in pii.pii_scan(df).collect()}
    assert rep == {("note", "email"): 1, ("note", "ssn"): 1, ("note", "phone"): 1, ("note", "credit_card"): 1}
    clean, report = pii.without_pii_columns(df)
    assert clean.columns == ["ref", "Volume"] and len(report) == 4
    with pytest.raises(pii.PersonalDataFound, match="note: 1 x email"):
        pii.pii_gate(df)
    pii.pii_gate(clean)


def test_score_forecasts_worked_example(spark):
    log = spark.createDataFrame([(dt.datetime(2024, 1, d), p, b) for d, p, b in
                                 [(1, 100.0, 150.0), (2, 200.0, 250.0), (3, 300.0, 350.0)]],
                                "TimePeriod timestamp, Point_Forecast double, Safety_Buffer_99 double")
    act = spark.createDataFrame([(dt.datetime(2024, 1, d), v) for d, v in [(1, 110), (2, 190), (3, 360)]],
                                "TimePeriod timestamp, Volume long")
    s = monitoring.score_forecasts(log, act).first()
    assert s.n_matured == 3 and s.realised_mae == 26.6667 and s.coverage_99 == 66.67


def test_score_no_matured_rows(spark):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 2.0)],
                                "TimePeriod timestamp, Point_Forecast double, Safety_Buffer_99 double")
    act = spark.createDataFrame([(dt.datetime(2025, 1, 1), 5)], "TimePeriod timestamp, Volume long")
    s = monitoring.score_forecasts(log, act).first()
    assert s.n_matured == 0 and s.realised_mae is None and s.coverage_99 is None


def test_concept_drift_rules(spark):
    summ = spark.createDataFrame([("a", 1, 200.0), ("b", 1, 200.0), ("c", 0, None), ("d", 1, 200.0)],
                                 "k string, n_matured long, realised_mae double")
    base = spark.createDataFrame([("a", 10.0), ("b", 190.0), ("c", 10.0), ("d", 0.0)], "k string, baseline_mae double")
    out = {r.k: r.drift_detected for r in monitoring.concept_drift(summ, base, ["k"]).collect()}
    assert out == {"a": True, "b": False, "c": False, "d": False}
    assert [r.k for r in monitoring.retrain_set(monitoring.concept_drift(summ, base, ["k"]), ["k"]).collect()] == ["a"]


def test_ks_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 400).round(2), rng.normal(0.3, 1, 300).round(2)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    got = monitoring.data_drift(ref, cur, ["x"]).first()
    grid = np.union1d(a, b)
    exp = max(abs(np.searchsorted(np.sort(a), g, "right") / len(a) - np.searchsorted(np.sort(b), g, "right") / len(b))
              for g in grid)
    assert got.statistic == pytest.approx(exp)
    assert got.drifted == (exp > monitoring.ks_critical(0.05) * np.sqrt((400 + 300) / (400 * 300)))


def test_request_validation_rejects_injection(spark):
    rows = [("2024-01-01", "d", 0.99), ("2024-01-01; DROP TABLE x", "D", 0.99), ("1" * 50, "H", 0.99),
            ("2024-01-01", "DROP", 0.99), ("2024-01-01", "H", 1.5), ("2024-01-01", "H", -0.1), ("2024-01-01", "H", 2.0)]
    df = spark.createDataFrame(rows, "time_period string, granularity string, confidence_level double")
    out = [(r.valid, r.reject_reason) for r in audit.request_validation(df).collect()]
    assert out == [(True, None), (False, "time_period"), (False, "time_period"), (False, "granularity"),
                   (False, "confidence_level"), (False, "confidence_level"), (False, "confidence_level")]


def test_latency_counts_and_exact_quantile(spark):
    df = spark.createDataFrame([(x,) for x in [0.001] * 98 + [0.3, 20.0, None]], "latency_s double")
    h = {r.le: r.n_cumulative for r in audit.latency_histogram(df).collect()}
    assert h[0.005] == 98 and h[0.5] == 99 and h[10.0] == 99 and h[float("inf")] == 100
    p = audit.latency_quantile(df, 0.99).first()
    assert p.n == 100 and p.p99 == pytest.approx(0.3 + 0.01 * 19.7)


def test_drift_does_not_hang_on_exchange_reuse(spark):
    rng = np.random.default_rng(5)
    ref = spark.createDataFrame([(float(x), "ab"[int(x > 0)]) for x in rng.normal(0, 1, 3000)], "x double, s string")
    cur = spark.createDataFrame([(float(x), "abc"[int(x > 0) + int(x > 1.5)]) for x in rng.normal(0.1, 1, 2000)], "x double, s string")
    def run():
        return {r.feature: (r.statistic, r.drifted, r.reason) for r in monitoring.data_drift(ref, cur, ["x", "s"]).collect()}
    with_reuse = run()
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert run() == with_reuse
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert 0 < with_reuse["x"][0] < 1 and with_reuse["s"][1] is True


def test_drift_of_empty_window_and_stored_baseline(spark, tmp_path):
    from surgecast.plans import jobs

    ref = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    rows = monitoring.data_drift(ref, ref.limit(0), ["x", "s"]).collect()
    assert {(r.feature, r.drifted, r.reason) for r in rows} == {("x", False, "no current data"), ("s", False, "no current data")}
    errs = spark.createDataFrame([], "mae_degradation double, concept_drift boolean")
    one = monitoring.drift_summary(monitoring.data_drift(ref, ref.limit(0), ["x", "s"]), errs).collect()
    assert len(one) == 1 and one[0].drift_detected is False and one[0].reason == "no current data"
    first = jobs.drift_job(spark, ref, ["x", "s"], str(tmp_path / "base")).collect()
    assert all(r.statistic == 0 and not r.drifted for r in first)
    far = spark.createDataFrame([(float(i), "z") for i in range(100, 200)], "x double, s string")
    later = {r.feature: r for r in jobs.drift_job(spark, far, ["x", "s"], str(tmp_path / "base")).collect()}
    assert later["x"].statistic == 1.0 and later["x"].n_reference == 2 and later["s"].drifted


def test_verify_artifacts(spark):
    hashes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, sha256 string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file string, expected_sha256 string")
    got = {r.file: r.status for r in audit.verify_artifacts(hashes, manifest).collect()}
    assert got == {"a": "verified", "b": "mismatch", "c": "unlisted", "d": "missing"}


def test_upsert_null_and_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    row = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3)], "k string, v int")
    for _ in range(2):
        sinks.upsert_log(spark, row, path, ["k"], partition_col=None, order_col="v")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(None, 2), ("a", 3)}
    assert spark.read.parquet(path).count() == 2
    sinks.upsert_log(spark, spark.createDataFrame([("a", 2)], "k string, v int"), path, ["k"], partition_col=None, order_col="v")
    assert spark.read.parquet(path).where("k = 'a'").first().v == 3


def test_offline_store_keeps_the_other_granularity(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    for g in ("D", "H"):
        sinks.write_offline_features(spark.createDataFrame([(1.0, g, "2024-01")], "x double, granularity string, month string"), path)
    assert {r.granularity for r in spark.read.parquet(path).collect()} == {"D", "H"}


def test_upsert_idempotent_and_replaces(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "TimePeriod timestamp, Point_Forecast double")
    sinks.upsert_log(spark, row, path)
    sinks.upsert_log(spark, row, path)
    assert spark.read.parquet(path).count() == 1
    row2 = spark.createDataFrame([(dt.datetime(2024, 1, 1), 2.0), (dt.datetime(2024, 2, 1), 3.0)],
                                 "TimePeriod timestamp, Point_Forecast double")
    sinks.upsert_log(spark, row2, path)
    got = sorted((r.TimePeriod.month, r.Point_Forecast) for r in spark.read.parquet(path).collect())
    assert got == [(1, 2.0), (2, 3.0)]


def test_run_task_unknown_raises(spark):
    from surgecast.plans.jobs import run_task

    with pytest.raises(ValueError):
        run_task("nope", spark)


def test_missing_columns_rejected(spark):
    df = spark.createDataFrame([(1.0,)], "Volume double")
    with pytest.raises(quality.DataQualityError):
        quality.validate_demand(df)


def _counts_drift(ref, cur):
    """Measures by hand, from whole columns."""
    values = sorted(set(ref) | set(cur))
    area = gap = 0.0
    for v, nxt in zip(values, values[1:] + [values[-1]]):
        d = abs(np.mean([x <= v for x in ref]) - np.mean([x <= v for x in cur]))
        gap, area = max(gap, d), area + d * (nxt - v)
    return gap, area / np.std(ref)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_drift_measures_by_hand(spark, parts):
    """Whatever the number of ranges that a column is cut into."""
    rng = np.random.default_rng(11)
    ref, cur = np.round(rng.normal(size=300), 2), np.round(rng.normal(0.4, 1.3, 250), 2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        a = spark.createDataFrame([(float(v), "abc"[i % 3]) for i, v in enumerate(ref)] + [(None, None)], "x double, s string")
        b = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(cur)] + [(float("nan"), None)], "x double, s string")
        few = {r.feature: r for r in monitoring.drift_by_size(a, b, ["x", "s", ]).collect()}
        many = {r.feature: r for r in monitoring.drift_by_size(a, b, ["x", "s"], small=10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    gap, area = _counts_drift(ref.tolist(), cur.tolist())
    assert few["x"].test == "ks" and few["x"].statistic == pytest.approx(gap)
    assert many["x"].test == "earth-mover" and many["x"].statistic == pytest.approx(area) and many["x"].drifted
    seen = np.array([[100, 100, 100], [125, 125, 0]], float)
    want = seen.sum(axis=0, keepdims=True) * seen.sum(axis=1, keepdims=True) / seen.sum()
    assert few["s"].test == "chi-square" and few["s"].statistic == pytest.approx(((seen - want) ** 2 / want).sum())
    assert few["s"].threshold == pytest.approx(5.991, rel=0.02) and few["s"].drifted
    assert many["s"].test == "jensen-shannon"


def test_drift_by_size_of_odd_columns(spark):
    one = spark.createDataFrame([(1.0, "k")] * 3, "x double, s string")
    rows = {r.feature: r for r in monitoring.drift_by_size(one, one, ["x", "s"]).collect()}
    assert not rows["x"].drifted and rows["s"].threshold is None and not rows["s"].drifted
    none = {r.feature: r.reason for r in monitoring.drift_by_size(one, one.limit(0), ["x", "s"]).collect()}
    assert none == {"x": "no current data", "s": "no current data"}


def test_digest_is_fed_piece_by_piece(spark, tmp_path):
    import hashlib

    files = {"a b.bin": b"x" * 100_000, "one": b"y", "ü%20.bin": bytes(range(256)) * 40}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file: (r.length, r.sha256) for r in audit.artifact_hashes(spark, f"{tmp_path}/*", piece=777).collect()}
    assert sorted(got.values()) == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in files.values())


def test_snapshots_switch_as_a_whole(spark, tmp_path):
    """A half written snapshot is not seen, and the next one takes its place."""
    from surgecast.sources import sinks

    path = str(tmp_path / "versions")
    assert sinks.read_snapshot(spark, path) is None
    for i in range(4):
        assert sinks.write_snapshot(spark, spark.range(i + 1), path).count() == i + 1
        broken = tmp_path / "versions" / f"snapshot-{i + 1:09d}"
        broken.mkdir()
        (broken / "part-0.parquet").write_bytes(b"half")
        assert sinks.read_snapshot(spark, path).count() == i + 1
    assert len([p for p in (tmp_path / "versions").iterdir() if (p / "_SUCCESS").exists()]) == 2


def test_scan_of_columns_with_odd_names(spark):
    from surgecast.operators import pii

    df = spark.createDataFrame([("me@example.com", "x")], "`it's a.b` string, `back``tick` string")
    assert [(r.column, r.pattern, r.n) for r in pii.pii_scan(df).collect()] == [("it's a.b", "email", 1)]
