"""Leaf-wise trees against searches written out in plain Python."""

import heapq
import itertools

import numpy as np
import pyspark.sql.functions as F
import pytest

from surgecast.operators import boosting, model


def data(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 30, n), np.round(rng.normal(size=n), 3), rng.integers(0, 3, n), np.full(n, 7.0)], axis=1).astype(float)
    y = np.round(x[:, 0] * (x[:, 2] + 1) + 5 * np.sin(x[:, 1]) + rng.normal(size=n), 3)
    return x, y


def frame(spark, x, y):
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join([*(f"f{i} double" for i in range(x.shape[1])), "y double"]))


def names(x):
    return [f"f{i}" for i in range(x.shape[1])]


def nodes(m):
    return sorted(map(tuple, m.nodes.collect()))


def brute_split(x, r, rows, min_rows):
    """Best of all splits of ``rows``, every value of every input tried."""
    best = None
    total = r[rows].sum()
    for f in range(x.shape[1]):
        for t in sorted(set(x[rows, f]))[:-1]:
            left = [i for i in rows if x[i, f] <= t]
            right = [i for i in rows if x[i, f] > t]
            if len(left) < min_rows or len(right) < min_rows:
                continue
            gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - total ** 2 / len(rows)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, left, right
    return best


def brute_trees(x, y, trees, leaves, min_rows, step):
    """Predictions of the training rows by best-first growth with raw values."""
    at = np.full(len(y), y.mean())
    for _ in range(trees):
        r, count = y - at, itertools.count()
        queue, ends = [], []

        def offer(rows):
            s = brute_split(x, r, rows, min_rows)
            if s is None:
                ends.append(rows)
            else:
                heapq.heappush(queue, (-s[0], next(count), rows, s[2], s[3]))

        offer(list(range(len(y))))
        while queue and len(queue) + len(ends) < leaves:
            _, _, _, left, right = heapq.heappop(queue)
            offer(left)
            offer(right)
        for rows in [*ends, *(q[2] for q in queue)]:
            at[rows] += step * r[rows].mean()
    return at


@pytest.mark.parametrize("leaves,min_rows", [(2, 1), (8, 5), (31, 15)])
def test_as_a_search_over_every_split(spark, leaves, min_rows):
    x, y = data()
    df = frame(spark, x, y)
    m = boosting.fit(df, names(x), trees=4, leaves=leaves, min_rows=min_rows, step=0.3)
    got = {tuple(r[n] for n in names(x)): r.prediction for r in m.predict(df).collect()}
    want = brute_trees(x, y, 4, leaves, min_rows, 0.3)
    assert np.allclose([got[tuple(r)] for r in x], want, atol=1e-6)
    per = {}
    for r in m.nodes.where("input is null").collect():
        per.setdefault(r.tree, []).append(r["rows"])
    assert all(len(v) <= leaves and min(v) >= min_rows and sum(v) == len(y) for v in per.values())


def test_rounds_over_partitions_grow_the_same_trees(spark):
    """One Spark aggregation a round, against all rounds in the one task of a small table;
    over a refresh of the residuals."""
    x, y = data(400, 4)
    df = frame(spark, x, y)
    kw = dict(trees=boosting.REFRESH + 2, leaves=6, min_rows=10, step=0.2)
    here = boosting.fit(df, names(x), **kw)
    apart = boosting.fit(df.repartition(7), names(x), rows_per_task=100, **kw)
    assert nodes(here) == nodes(apart) and here.base == apart.base
    again = boosting.fit(df.orderBy(F.desc("f1")), names(x), **kw)
    assert nodes(here) == nodes(again)


def test_sums_are_exact_for_any_size_of_number(spark):
    for scale in (1e-6, 1.0, 1e9):
        x, y = data(150, 5)
        df = frame(spark, x, y * scale)
        a = boosting.fit(df, names(x), trees=3, leaves=8, min_rows=5)
        b = boosting.fit(df.repartition(5), names(x), trees=3, leaves=8, min_rows=5, rows_per_task=40)
        assert nodes(a) == nodes(b)
        assert a.base == pytest.approx(y.mean() * scale, rel=1e-9)


def test_walk_is_the_table_read_by_hand(spark, tmp_path):
    x, y = data(200, 6)
    df = frame(spark, x, y)
    m = boosting.fit(df, names(x), trees=7, leaves=12, min_rows=4)
    m.save(str(tmp_path / "m"))
    back = boosting.Boosted.load(spark, str(tmp_path / "m"), names(x))
    table = {(r.tree, r.node): r for r in back.nodes.collect()}

    def by_hand(row):
        total = back.base
        for t in range(7):
            at = table[t, 0]
            while at.input is not None:
                at = table[t, at.low if row[at.input] <= at.threshold else at.high]
            total += at.value
        return total

    other = np.round(np.random.default_rng(7).normal(size=(60, x.shape[1])) * 20, 2)
    clash = frame(spark, other, np.arange(60)).withColumnRenamed("y", "value").withColumn("_x", F.lit("own")).withColumn("tree", F.lit(1)).repartition(5)
    got = back.predict(clash).collect()
    assert len(got) == 60 and all(r.prediction == by_hand([r[n] for n in names(x)]) and r["_x"] == "own" for r in got)
    assert [r.prediction for r in m.predict(df.limit(0)).collect()] == []


def test_odd_tables(spark):
    x, y = data(50, 8)
    none = boosting.fit(frame(spark, x, y).limit(0), names(x), trees=3)
    assert [r.prediction for r in none.predict(frame(spark, x[:2], y[:2])).collect()] == [0.0, 0.0]
    flat = boosting.fit(frame(spark, x, np.full(50, 4.25)), names(x), trees=3)
    assert {r.prediction for r in flat.predict(frame(spark, x, y)).collect()} == {4.25}
    zeros = boosting.fit(frame(spark, x, np.zeros(50)), names(x), trees=2)
    assert {r.prediction for r in zeros.predict(frame(spark, x, y)).collect()} == {0.0}
    one = boosting.fit(frame(spark, x[:1], y[:1]), names(x), trees=2)
    assert one.predict(frame(spark, x[:1], y[:1])).first().prediction == pytest.approx(y[0])
    same = boosting.fit(frame(spark, np.repeat(x[:1], 40, axis=0), np.arange(40.0)), names(x), trees=2, min_rows=1)
    assert same.nodes.where("input is not null").count() == 0
    many = boosting.fit(frame(spark, np.arange(2000.0).reshape(-1, 1), np.arange(2000.0)), ["f0"], trees=1, leaves=400, min_rows=1, step=1.0)
    assert many.nodes.where("input is not null").count() == boosting.BINS - 1  # as many cuts as there are bins


def test_few_rows_get_small_trees(spark, monkeypatch):
    """Under 200 rows in all, the holdout's trees have at most 15 leaves."""
    seen = []
    fit = model.fit_gbt
    monkeypatch.setattr(model, "fit_gbt", lambda *a, leaves, **kw: seen.append(leaves) or fit(*a, leaves=leaves, **kw))
    for n in (199, 200):
        x, y = data(n, 9)
        split = frame(spark, x, y).withColumn("role", F.when(F.col("f0") < 20, "train").otherwise("test"))
        tail = model.gbt_holdout(split, names(x), trees=2)
        assert tail.where("prediction is null").count() == 0
    assert seen == [15, 31]


def test_beats_the_naive_forecast_on_every_series(spark):
    from surgecast.plans import catalog

    rows = catalog.q_gbt_forecast(spark, "/root/testdata/sf0.01").select("event_type", "model_mae", "naive_mae", "beats_naive").distinct().collect()
    assert len(rows) == 5 and all(r.beats_naive and r.model_mae < r.naive_mae for r in rows)
