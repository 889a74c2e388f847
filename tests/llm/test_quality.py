import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surgecast.llm import quality

from .common import awkward, frame, sentence

SYMBOLS = [c for c in string.punctuation if c not in ".,;:!?'\"()-"]


def plain(text):
    """The statistics of one text, from their names."""
    b = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", b) if w]
    n, size, lines = max(len(words), 1), max(len(b), 1), b.split(b"\n")
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    pairs = set(zip(words, words[1:]))
    count = lambda chars: sum(b.count(c.encode()) for c in chars)
    upper, letters = count(string.ascii_uppercase), count(string.ascii_letters)
    has = lambda chars: sum(any(c.encode() in w for c in chars) for w in words)
    bare = sum(not re.search(rb"[A-Za-z0-9\x80-\xff]", w) for w in words)
    ended = sum(x[-1:] in (b".", b"!", b"?") for x in lines)
    s = math.sqrt
    return [math.log1p(size), math.log1p(len(words)), math.log1p(mean), math.log1p(s(max(sum(x * x for x in lengths) / n - mean ** 2, 0))),
            len(set(words)) / n, s(max(Counter(words).values(), default=0) / n), s(sum(x == y for x, y in zip(words, words[1:])) / n),
            len(pairs) / max(len(words) - 1, 1), s(count(string.punctuation) / size), s(count(SYMBOLS) / size), s(count(string.digits) / size),
            s(upper / max(letters, 1)), s(has(SYMBOLS) / n), s(bare / n), s(sum(w[:1].isupper() for w in words) / n), math.log(len(lines)),
            math.log1p(len(words) / len(lines)), ended / len(lines), math.log1p(len(words) / (1 + count(".!?"))), s(sum(x > 127 for x in b) / size),
            s(sum(x in b" \t\n\x0b\x0c\r" for x in b) / size), math.log1p(max(lengths, default=0))]


def test_statistics_against_plain_python():
    texts = [t for _, t in awkward()] + ["A.\nB!\nc\n", "x\n\n", "same same same", "| a | b |", "ÄÖ %%% ###", "0" * 70_000 + "\n" + "y" * 600_000]
    got = np.concatenate([quality.statistics(run) for _, run in quality.W.chunks(texts)])
    assert got.shape == (len(texts), quality.D)
    np.testing.assert_allclose(got, np.array([plain(t) for t in texts]), rtol=1e-9, atol=1e-9)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n, seed=1):
    """Prose (1) against menus, repeated words and sprinkled symbols (0)."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, good = sentence(rng, rng.randint(3, 120)).capitalize() + ".", int(rng.random() < 0.8)
        if not good:
            kind = rng.randrange(3)
            words = text.split()
            text = " | ".join(words) if kind == 0 else " ".join([words[0]] * 60) if kind == 1 else " ".join(w + rng.choice(["%%%", "###", "&&"]) for w in words)
        rows.append((i, text))
        labels.append((i, good))
    return rows, labels


def scored(spark, rows, labels, **kw):
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    return quality.score(frame(spark, rows, kw.pop("clash", ())), lab, **kw)


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    got = {r.doc_id: r for r in scored(spark, rows, labels).collect()}
    assert len(got) == len(rows)
    out = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert [got[i].held_out for i, _ in labels] == [held(i) for i, _ in labels]
    assert np.mean([p == y for p, y in out]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_play_no_part(spark):
    rows, labels = corpus(200, 2)
    other = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = ({r.doc_id: round(r.score, 9) for r in scored(spark, rows, x).collect()} for x in (labels, other))
    assert a == b


def test_sums_and_density_against_numpy(spark):
    """The learned discriminant is that of the formula, over all rows at once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, quality.D)) @ rng.normal(size=(quality.D, quality.D)) + 3
    y = (rng.random(160) < 0.6).astype(int)
    fold = rng.integers(0, quality.FOLDS, 160)
    df = spark.createDataFrame([(int(f), int(k), v.tolist()) for f, k, v in zip(fold, y, x)], "fold int, label int, _x array<double>").repartition(4)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    z = np.clip((x - centre) / scale, -quality.CLIP, quality.CLIP)
    got = quality.sums(df, centre, scale)
    for (f, k), s in got.items():
        own = z[(fold == f) & (y == k)]
        assert s.n == len(own)
        np.testing.assert_allclose(s.first, own.sum(axis=0), atol=1e-9)
        np.testing.assert_allclose(s.second, own.T @ own, atol=1e-8)
    whole = [quality.Sums(float((y == k).sum()), z[y == k].sum(axis=0), z[y == k].T @ z[y == k]) for k in (0, 1)]
    model = quality.fitted(whole, 0.3, 0.1, centre, scale)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = sum(c.n * s for c, s in zip(whole, covs)) / 160
    common = 0.9 * common + 0.1 * np.diag(np.diag(common) + 1e-3)
    logs = []
    for k in (0, 1):
        share = max(0.3, min(1, 2 * quality.D / whole[k].n))
        cov = (1 - share) * covs[k] + share * common
        d = z - z[y == k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    np.testing.assert_allclose(model.difference(x), logs[1] - logs[0], rtol=1e-8, atol=1e-8)
    learned = quality.learn(df)
    assert isinstance(learned, quality.Discriminant) and learned.slope >= 0
    np.testing.assert_allclose(learned.mean[0], whole[0].first / whole[0].n, atol=1e-9)


def test_calibration_finds_the_logistic():
    rng = np.random.default_rng(6)
    counts = np.zeros((2, quality.BINS))
    x = (np.arange(quality.BINS) - quality.BINS // 2 + 0.5) * quality.WIDTH
    n = rng.integers(50, 200, quality.BINS) * 1000
    p = 1 / (1 + np.exp(-(0.7 * x - 1.5)))
    counts[1], counts[0] = n * p, n * (1 - p)
    a, b, _ = quality.calibrated(counts)
    assert a == pytest.approx(0.7, abs=0.02) and b == pytest.approx(-1.5, abs=0.05)


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, labels twice or null."""
    rows, labels = corpus(120, 3)
    rows = [(1000 + i, t) for i, t in rows] + awkward() + [(77, "word " * 200_000)]
    labels = [(1000 + i, y) for i, y in labels] + [(3, 0), (3, 1), (None, 1), (4, None), (8, 1)]
    clash = ["score", "predicted", "held_out", "label", "fold", "_x", "_row", "_text", "_id", "quality"]
    out = scored(spark, rows, labels, clash=clash)
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    empty = {r.score for r in got if r.doc_id in (0, 1)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 8}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [zlib.crc32(b"") % 3 == 1]
    carried = scored(spark, rows, labels, clash=clash, carry=True)
    assert set(carried.columns) == {"doc_id", "text", *clash}
    assert carried.where("label = 'own' and _x = 'own'").count() == len(rows)


def test_one_class_and_empty_tables(spark):
    rows = [(i, f"text {i}") for i in range(20)]
    assert {r.score for r in scored(spark, rows, [(i, 1) for i in range(20)]).collect()} == {1.0}
    assert {r.score for r in scored(spark, rows, [(i, 0) for i in range(20)]).collect()} == {0.0}
    assert {r.score for r in scored(spark, rows, []).collect()} == {0.0}
    assert scored(spark, [], [(1, 1)]).collect() == []
    few = scored(spark, rows, [(i, i % 2) for i in range(20)]).select(F.min("score"), F.max("score")).first()
    assert 0 <= few[0] <= few[1] <= 1
