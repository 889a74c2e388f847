import datetime as dt

import pyspark.sql.functions as F

from surgecast.operators import ingest


def raw_trips(spark):
    """1,000 stamps 15 min apart, the first 10 repeated, 5 nulls, shuffled."""
    import random

    start = dt.datetime(2024, 1, 1)
    stamps = [start + dt.timedelta(minutes=15 * i) for i in range(1000)]
    rows = stamps + stamps[:10] + [None] * 5
    random.Random(42).shuffle(rows)
    return spark.createDataFrame([(s,) for s in rows], "CreatedStamp timestamp")


def test_hourly_counts_invariants(spark):
    clean = ingest.clean_events(raw_trips(spark), as_of="2030-01-01")
    hourly = ingest.demand(clean, "CreatedStamp", "H").toPandas()
    assert hourly["Volume"].notna().all() and (hourly["Volume"] >= 0).all()
    assert hourly["TimePeriod"].is_monotonic_increasing or hourly.sort_values("TimePeriod") is not None
    # no dedupe: every non-null record counts
    assert int(hourly["Volume"].sum()) == 1010
    assert len(hourly) == 250  # 1,000 quarter hours span 250 hours


def test_daily_rollup_equals_daily_count(spark):
    clean = ingest.clean_events(raw_trips(spark), as_of="2030-01-01")
    hourly = ingest.demand(clean, "CreatedStamp", "H")
    daily_rollup = ingest.rollup(hourly, "D").toPandas().sort_values("TimePeriod").reset_index(drop=True)
    daily_direct = ingest.demand(clean, "CreatedStamp", "D").toPandas().sort_values("TimePeriod").reset_index(drop=True)
    assert daily_rollup["Volume"].tolist() == daily_direct["Volume"].tolist()
    assert (daily_rollup["TimePeriod"].dt.hour == 0).all()


def test_gap_fill_zero_and_panel_equals_singles(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 5)), ("a", dt.datetime(2024, 1, 1, 3, 5)),
            ("b", dt.datetime(2024, 1, 1, 1, 0)), ("b", dt.datetime(2024, 1, 1, 1, 30)),
            ("b", dt.datetime(2024, 1, 1, 2, 10))]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    panel = ingest.demand(df, "ts", "H", ["k"]).orderBy("k", "TimePeriod").collect()
    assert [(r.k, r.TimePeriod.hour, r.Volume) for r in panel] == [
        ("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 2), ("b", 2, 1)]
    single = ingest.demand(df.filter("k = 'a'"), "ts", "H").orderBy("TimePeriod").collect()
    assert [r.Volume for r in single] == [1, 0, 0, 1]
    glob = ingest.demand(df, "ts", "H", ["k"], bounds="global").filter("k = 'b'").count()
    assert glob == 4


def test_gap_fill_chunks_match_single_chunk(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i),) for i in range(40)], "ts timestamp")
    agg = ingest.count_per_period(df, "ts", "H")
    a = ingest.gap_fill(agg, [], "H", chunk=5).orderBy("_idx").collect()
    b = ingest.gap_fill(agg, [], "H", chunk=100000).orderBy("_idx").collect()
    assert a == b and len(a) == 274


def test_coerce_and_range_filter(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("not a time",), (None,), ("2001-05-05 00:00:00",),
                                ("2030-01-01 00:00:00",)], "s string")
    out = ingest.clean_events(df, "s", as_of="2025-01-01 00:00:00").collect()
    assert [r.s for r in out] == [dt.datetime(2024, 1, 1, 10)]


def test_utc_conversion_from_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 8, 0),)], "ts timestamp_ntz")
    out = ingest.clean_events(df, "ts", source_tz="America/New_York", as_of="2030-01-01").first().ts
    assert out == dt.datetime(2024, 7, 1, 12, 0)


def test_bounds_inclusive_and_recent_window(spark):
    rows = [(dt.datetime(2026, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "TimePeriod timestamp, Volume double")
    assert ingest.bound_as_of(df, "2026-01-05 00:00:00").count() == 5
    # cutoff = as_of - 7 days is inclusive: 2026-01-03 .. 2026-01-10
    assert ingest.recent_window(df, "2026-01-10 00:00:00", days=7).count() == 8


def test_filters_push_down(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = ingest.clean_events(ev, "ts", as_of="2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "LessThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_as_of_is_needed(spark):
    import pytest

    with pytest.raises(TypeError):
        ingest.clean_events(raw_trips(spark))
    with pytest.raises(ValueError):
        ingest.range_filter(raw_trips(spark), "CreatedStamp", None)


def test_null_series_key_is_a_series(spark):
    from surgecast.operators import features as feat

    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for k in ("a", None) for h in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    d = ingest.demand(df, "ts", "H", ["k"])
    for f in (feat.lag_features(d, "H", ["k"]), feat.ema_features(d, "H", ["k"]), feat.ema_features(d, "H", ["k"], block_size=16)):
        assert {r.k: r["count"] for r in f.groupBy("k").count().collect()} == {"a": 60, None: 60}
    daily = ingest.rollup(d, "D", ["k"])
    both = ingest.rollup_consistency(d, daily, ["k"]).collect()
    assert len(both) == 6 and all(r.consistent for r in both) and sum(r.k is None for r in both) == 3


def test_missing_period_is_an_error(spark):
    import pytest
    from pyspark.errors import PySparkException

    from surgecast.operators import features as feat

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1.0) for h in range(60) if h != 30]
    df = spark.createDataFrame(rows, "TimePeriod timestamp, Volume double")
    with pytest.raises(PySparkException, match="missing or repeated"):
        feat.lag_features(df, "H").collect()


def test_month_from_file_name(spark, tmp_path):
    import pytest

    from surgecast.sources import files

    assert files.months_of_file("/x/trips_2024-01.parquet") == ("2024-01", "2024-01")
    assert files.months_of_file("/x/2024-01_2024-03") == ("2024-01", "2024-03") and files.months_of_file("/2024-01/trips") is None
    rows = [(dt.datetime(2024, m, 15),) for m in (1, 2, 3)]
    spark.createDataFrame(rows, "ts timestamp").write.parquet(str(tmp_path / "trips_2024-02"))
    assert files.monthly_union(spark, [(str(tmp_path / "trips_2024-02"), "ts")]).count() == 1
    with pytest.raises(ValueError):
        files.monthly_union(spark, [(str(tmp_path / "trips"), "ts")])
    with pytest.raises(ValueError):
        files.read_source(spark, {"kind": "sheet"})


def test_scan_csv(spark, tmp_path):
    from surgecast.sources import files

    (tmp_path / "t.csv").write_text("CreatedStamp,x\n2024-01-01 00:10:00,1\n2024-01-01 00:20:00,2\n")
    raw = files.read_source(spark, {"kind": "files", "path": str(tmp_path / "t.csv")})
    assert ingest.clean_events(raw, as_of="2030-01-01").count() == 2
