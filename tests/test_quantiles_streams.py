"""Exact quantiles, windowed quantiles, late events and per-entity loads."""

import datetime as dt
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from surgecast.operators import audit, quantiles
from surgecast.sources.online import materialize_incremental, read_online
from surgecast.streaming import incremental


def values(seed=1):
    rng = np.random.default_rng(seed)
    out = {"hot": rng.normal(size=4000), "shared": np.where(rng.random(3000) < 0.7, 5.0, rng.random(3000) * 10), "one": np.array([3.5]),
           "same": np.full(2500, -2.0), "skew": np.exp(rng.normal(size=2500) * 8), "pair": np.array([1.0, 2.0]), None: np.arange(50.0)}
    return [(k, float(v)) for k, vs in out.items() for v in vs] + [("hot", None), ("none", None)]


@pytest.mark.parametrize("small", [100_000, 20])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_equals_percentile(spark, monkeypatch, small, q):
    """Also when all but 20 rows have to be ruled out by ranges."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    df = spark.createDataFrame(values(), "k string, v double").repartition(5)
    want = {r.k: (r.n, r.p) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", q).alias("p")).collect()}
    got = {r.k: (r.n, r.value) for r in quantiles.exact_quantile(df, "v", q, ["k"]).collect()}
    assert set(got) == set(want)
    for k, (n, p) in want.items():
        assert got[k][0] == n and (got[k][1] == pytest.approx(p, rel=1e-12) if p is not None else got[k][1] is None)


def test_quantile_without_groups_and_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 10)
    df = spark.createDataFrame(values(), "k string, v double")
    row = quantiles.exact_quantile(df, "v", 0.9).first()
    assert row.value == pytest.approx(df.agg(F.percentile("v", 0.9)).first()[0])
    none = quantiles.exact_quantile(df.limit(0), "v", 0.9).first()
    assert none.n == 0 and none.value is None
    assert quantiles.exact_quantile(df.limit(0), "v", 0.9, ["k"]).collect() == []
    odd = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", float("inf"))], "k string, v double")
    assert quantiles.exact_quantile(odd, "v", 0.0, ["k"]).first().value == 1.0
    assert np.isnan(quantiles.exact_quantile(odd, "v", 1.0, ["k"]).first().value)


def by_hand(rows, until, q, bounds):
    """What a dashboard's quantile of a five-minute rate is."""
    lat = [v for t, v in rows if until - dt.timedelta(minutes=5) <= t.replace(second=0, microsecond=0) < until]
    if not lat:
        return None
    counts = [sum(v <= b for v in lat) for b in bounds]
    rank = q * len(lat)
    for i, c in enumerate(counts):
        if c >= rank:
            low, before = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
            return low + (bounds[i] - low) * (rank - before) / (c - before)
    return bounds[-1]


def test_windowed_quantile_worked(spark):
    rng = random.Random(2)
    at = dt.datetime(2024, 1, 1, 10, 0)
    rows = [(at + dt.timedelta(seconds=rng.randrange(0, 1500)), rng.choice([0.003, 0.02, 0.4, 3.0, 50.0]) * rng.random() * 2) for _ in range(120)]
    rows += [(at + dt.timedelta(minutes=50), 0.2)]
    df = spark.createDataFrame([("g", *r) for r in rows] + [("g", None, 1.0), ("g", at, None), ("g", at, float("nan"))], "k string, ts timestamp, latency_s double")
    from surgecast.config import LATENCY_BUCKETS

    got = {r.until: r for r in audit.windowed_quantile(df, 0.9, group_cols=["k"]).collect()}
    want = {}
    for m in range(0, 60):
        until = at + dt.timedelta(minutes=m)
        v = by_hand(rows, until, 0.9, LATENCY_BUCKETS)
        if v is not None:
            want[until] = v
    assert set(got) == set(want)
    for until, v in want.items():
        assert got[until].value == pytest.approx(v)
    last = got[at + dt.timedelta(minutes=55)]
    assert last.rate == pytest.approx(1 / 300)


def events(rows):
    return [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for k, m in rows]


def test_late_events_correct_the_hours(spark, tmp_path):
    """Counts equal the batch's, late ones are told apart, nothing counts twice."""
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    slices = [[("a", 10), ("a", 70), ("b", 20)], [("a", 200), ("a", 30), ("b", 150), (None, 205)], [("a", 65), ("a", 300), ("b", 20), ("b", 301)]]
    late = {}
    reach = None
    for rows in slices:
        spark.createDataFrame(events(rows), "k string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # a second run finds nothing new
            hourly, parts = incremental.run_counted_stream(spark, src, "ts", ["k"], root, watermark="1 hour")
        for k, m in rows:
            if reach is not None and m < reach - 60:
                late[k, m // 60] = late.get((k, m // 60), 0) + 1
        reach = max([m for _, m in rows] + ([] if reach is None else [reach]))
    table = spark.read.parquet(hourly)
    whole = incremental.hourly_counts(spark.createDataFrame(events(sum(slices, [])), "k string, ts timestamp"), "ts", ["k"])
    got = sorted(map(str, table.select("k", "TimePeriod", "Volume").collect()))
    assert got == sorted(map(str, whole.collect()))
    told = spark.read.parquet(parts).groupBy("k", "TimePeriod").agg(F.sum("n_late").alias("n")).where("n > 0").collect()
    assert {(r.k, r.TimePeriod.hour): r.n for r in told} == late and late


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """A run that ended between writing and committing a batch: the batch comes again."""
    import shutil

    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(events([("a", 5), ("a", 6), ("b", 90)]), "k string, ts timestamp").write.parquet(src)
    hourly, _ = incremental.run_counted_stream(spark, src, "ts", ["k"], root)
    shutil.rmtree(f"{root}/checkpoint/commits")
    incremental.run_counted_stream(spark, src, "ts", ["k"], root)
    assert sorted((r.k, r.Volume) for r in spark.read.parquet(hourly).collect()) == [("a", 2), ("b", 1)]


def test_entities_of_different_speed(spark, tmp_path):
    """A later load brings rows of a slow entity that are older than another's last."""
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("fast", day(d), float(d)) for d in range(1, 11)] + [("slow", day(d), 100.0 + d) for d in range(1, 11)] + [(None, day(4), 7.0)]
    df = spark.createDataFrame(rows, "e string, TimePeriod timestamp, x double")
    path = str(tmp_path / "online")
    first = df.where("e = 'fast' OR TimePeriod <= '2024-01-03'")
    assert materialize_incremental(spark, first, path, ["e"], "2024-01-08") == 2
    assert materialize_incremental(spark, first, path, ["e"], "2024-01-08") == 0
    assert materialize_incremental(spark, df, path, ["e"], "2024-01-06") == 2  # slow and the one without a name
    assert materialize_incremental(spark, df, path, ["e"], "2024-01-10", since="2024-01-07") == 2
    got = {r.e: (r.TimePeriod.day, r.x) for r in read_online(spark, path, "2024-01-10", 30 * 86_400 * 10**6).collect()}
    assert got == {"fast": (10, 10.0), "slow": (10, 110.0), None: (4, 7.0)}
