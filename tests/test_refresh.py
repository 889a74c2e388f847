"""Interval-wise rebuilds against full ones."""

import datetime as dt
import os
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from surgecast.plans import refresh

AS_OF = "2030-01-01 00:00:00"
KW = {"ts_col": "ts", "series_cols": ["k"], "as_of": AS_OF}


def events(seed, days=260):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(days=d, minutes=rng.randrange(1440))) for d in range(days) for k in ("a", "b") for _ in range(rng.randint(0, 4))]
    return rows + [(None, at + dt.timedelta(days=d)) for d in range(30, 120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp")


def table(spark, root, gran="D"):
    df = spark.read.parquet(f"{root}/features")
    cols = sorted(c for c in df.columns if c not in ("k", "TimePeriod", "month"))
    return {(r.k, r.TimePeriod): [r[c] for c in cols] for r in df.collect()}


def same(a, b):
    assert set(a) == set(b) and a
    for key, row in a.items():
        assert np.allclose(row, b[key], rtol=1e-12, atol=1e-12), key


def stamps(root, name):
    return {d: sorted(os.stat(os.path.join(p, f)).st_mtime_ns for f in os.listdir(p) if f.endswith(".parquet"))
            for d in os.listdir(f"{root}/{name}") if d.startswith("month=") for p in [os.path.join(root, name, d)]}


def cases():
    late = [("a", dt.datetime(2024, 5, 3, 4)), ("b", dt.datetime(2024, 5, 3, 5)), (None, dt.datetime(2024, 5, 3))]
    yield "late rows", late, None, ("2024-05-03 00:00:00", "2024-05-04 00:00:00")
    yield "rows gone", [], lambda k, t: t.date() == dt.date(2024, 4, 9), ("2024-04-09 00:00:00", "2024-04-10 00:00:00")
    yield "a new series", [("new", dt.datetime(2024, 3, 1) + dt.timedelta(days=d)) for d in range(60)], None, ("2024-03-01 00:00:00", "2024-05-01 00:00:00")
    yield "the end grows", [("a", dt.datetime(2024, 11, 20))], None, ("2024-11-20 00:00:00", "2024-11-21 00:00:00")
    yield "the end shrinks", [], lambda k, t: k is None and t >= dt.datetime(2024, 4, 1), ("2024-04-01 00:00:00", "2024-05-01 00:00:00")
    yield "the beginning moves", [], lambda k, t: k is None and t < dt.datetime(2024, 2, 15), ("2024-01-31 00:00:00", "2024-02-15 00:00:00")
    yield "an earlier beginning", [(None, dt.datetime(2024, 1, 3))], None, ("2024-01-03 00:00:00", "2024-01-04 00:00:00")


@pytest.mark.parametrize("name,more,gone,stretch", list(cases()), ids=[c[0] for c in cases()])
def test_equals_a_full_rebuild(spark, tmp_path, name, more, gone, stretch):
    old = events(1)
    new = [r for r in old if not (gone and gone(*r))] + more
    part, full = str(tmp_path / "part"), str(tmp_path / "full")
    refresh.refresh(spark, frame(spark, old), part, "D", **KW)
    done = refresh.refresh(spark, frame(spark, new), part, "D", start=stretch[0], end=stretch[1], **KW)
    refresh.refresh(spark, frame(spark, new), full, "D", **KW)
    same(table(spark, part), table(spark, full))
    assert set(done.counts) == {m for m in done.counts if stretch[0][:7] <= m <= stretch[1][:7]}


def test_only_months_in_reach_are_replaced(spark, tmp_path):
    """A late hour leaves earlier months and those beyond the averages' memory alone."""
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(hours=h)) for h in range(0, 24 * 150, 2)]
    root = str(tmp_path / "r")
    refresh.refresh(spark, frame(spark, rows), root, "H", **KW)
    counts, feats = stamps(root, "counts"), stamps(root, "features")
    done = refresh.refresh(spark, frame(spark, rows + [("a", dt.datetime(2024, 2, 10, 7, 30))] * 3), root, "H",
                           start="2024-02-10 07:00:00", end="2024-02-10 08:00:00", **KW)
    assert done.counts == ["2024-02"] and done.features == ["2024-02", "2024-03"]
    for name, before, months in (("counts", counts, done.counts), ("features", feats, done.features)):
        after = stamps(root, name)
        assert {m for m in after if after[m] != before[m]} == {f"month={m}" for m in months}
    full = str(tmp_path / "full")
    refresh.refresh(spark, frame(spark, rows + [("a", dt.datetime(2024, 2, 10, 7, 30))] * 3), full, "H", **KW)
    same(table(spark, root), table(spark, full))


def test_nothing_left_and_first_run(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for d in range(40)]
    done = refresh.refresh(spark, frame(spark, rows), root, "D", start="2024-01-01 00:00:00", end="2024-03-01 00:00:00", **KW)
    assert done.counts and spark.read.parquet(f"{root}/counts").agg(F.sum("Volume")).first()[0] == 40
    refresh.refresh(spark, frame(spark, []), root, "D", start="2024-01-01 00:00:00", end="2024-03-01 00:00:00", **KW)
    assert not os.path.isdir(f"{root}/features")
