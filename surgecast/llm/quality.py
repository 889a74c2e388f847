"""Quality: a regularised quadratic discriminant over transformed document statistics.

Each text becomes some twenty statistics (lengths, repetition, symbols, capitals, lines),
transformed towards a bell shape.  Per class, their mean and covariance follow from sums
over all labelled training rows; the covariance is shrunk towards the pooled one, and
that towards its diagonal.  How far is chosen by cross-validation: models that have not
seen a fold judge it.  A text's score is the logistic of its log-density difference (two
Mahalanobis distances by cached Cholesky factors), scaled and shifted as the judged
training rows ask for.

Texts are read once; what is learned needs one sum per (fold, class, pair of statistics)
and one histogram per candidate, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words as W
from .common import keep, released, text_bytes

FOLDS = 3
#: Candidates: shares of the pooled covariance and of its diagonal.
POOLED = (0.02, 0.1, 0.3, 0.6)
DIAGONAL = (0.02, 0.1, 0.3)
BINS, WIDTH = 400, 0.25  # of the histogram of log-density differences
CLIP = 8.0  # standardised statistics beyond it stand at it

STATISTICS = ["bytes", "words", "word_length", "length_spread", "distinct", "commonest", "neighbours", "distinct_pairs", "punctuation", "symbols",
              "digits", "capitals", "marked_words", "bare_words", "capitalised", "lines", "line_words", "ended_lines", "sentence_words", "wide",
              "blanks", "longest"]
D = len(STATISTICS)

_PUNCT, _SYMBOL, _UPPER, _LOWER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(6))
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_STOP[[ord(c) for c in ".!?"]] = True
_PLAIN = _UPPER | _LOWER | _DIGIT
_PLAIN[128:] = True
_BLANK = W._SEP


def _per(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over the runs ``first[i]:first[i + 1]``."""
    return np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))[first])


def _counts(value: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document and how often its commonest one stands there."""
    if not len(value):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])))
    at = np.flatnonzero(new)
    most = np.zeros(docs)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(v))))
    return np.bincount(d[at], minlength=docs).astype(float), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """The transformed statistics of texts, a row each."""
    w = W.scan(texts, fold=False)
    docs = len(texts)
    words = np.diff(w.first).astype(float)
    doc = np.repeat(np.arange(docs), np.diff(w.first))
    n, size = np.maximum(words, 1), np.maximum(np.diff(w.at) - 1, 1).astype(float)
    length = (w.end - w.start).astype(float)
    mean = _per(length, w.first) / n
    spread = np.sqrt(np.maximum(_per(length ** 2, w.first) / n - mean ** 2, 0))
    distinct, most = _counts(w.hash, doc, docs)
    pair = W.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) if len(w.hash) else w.hash
    inside = doc[1:] == doc[:-1]
    pairs, _ = _counts(pair[inside], doc[1:][inside], docs)
    same = np.zeros(len(w.hash))
    same[1:] = inside & (w.hash[1:] == w.hash[:-1])
    share = lambda mark: _per(mark[w.data], w.at) / size
    upto = {name: np.concatenate(([0], np.cumsum(mark[w.data]))) for name, mark in (("symbol", _SYMBOL), ("plain", _PLAIN))}
    within = lambda name: upto[name][w.end] - upto[name][w.start]
    upper, letters = _per(_UPPER[w.data], w.at), _per((_UPPER | _LOWER)[w.data], w.at)
    breaks, blanks = w.data == 10, _BLANK[w.data]
    breaks[w.at[1:] - 1] = blanks[w.at[1:] - 1] = False  # the separator of the chunk
    lines = _per(breaks, w.at) + 1
    ended = np.zeros(len(w.data))
    ended[1:] = breaks[1:] & _STOP[w.data[:-1]]
    last = np.maximum(w.at[1:] - 2, 0)
    closed = _per(ended, w.at) + (_STOP[w.data[last]] & (np.diff(w.at) > 1))
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    root = np.sqrt
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), distinct / n, root(most / n), root(_per(same, w.first) / n),
        pairs / np.maximum(words - 1, 1), root(share(_PUNCT)), root(share(_SYMBOL)), root(share(_DIGIT)), root(upper / np.maximum(letters, 1)),
        root(_per(within("symbol") > 0, w.first) / n), root(_per(within("plain") == 0, w.first) / n), root(_per(_UPPER[w.data[w.start]], w.first) / n),
        np.log(lines), np.log1p(words / lines), closed / lines, np.log1p(words / (1 + _per(_STOP[w.data], w.at))), root(_per(w.data > 127, w.at) / size),
        root(_per(blanks, w.at) / size), np.log1p(longest)], axis=1)


def measured(docs: DataFrame, carried: str, text_col: str) -> DataFrame:
    """``(carried, _x)``: the statistics of every row as an array; null texts are empty."""

    def run(batches):
        for batch in batches:
            made = [np.zeros((0, D))]
            for _, texts in W.chunks(batch.column(1).to_pylist()):
                made.append(statistics(texts))
            flat = pa.array(np.concatenate(made).ravel())
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, D, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), x], [carried, "_x"])

    head = docs.select(carried, text_bytes(text_col).alias("_b"))
    return head.mapInArrow(released(run), T.StructType([head.schema[carried], T.StructField("_x", T.ArrayType(T.DoubleType()))]))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes, over
    statistics standardised by ``centre`` and ``scale``."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray  # (2, D)
    factor: np.ndarray  # (2, D, D): rows times its transpose are whitened
    logdet: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, of raw statistics."""
        z = self.standardised(x)
        logs = [-0.5 * ((((z - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) + self.logdet[k]) for k in (0, 1)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh((self.slope * self.difference(x) + self.shift) / 2))


@dataclass
class Sums:
    """Rows, sums and sums of products of a class."""

    n: float
    first: np.ndarray
    second: np.ndarray

    def __sub__(self, other: "Sums") -> "Sums":
        return Sums(self.n - other.n, self.first - other.first, self.second - other.second)


def sums(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, clip: float = CLIP) -> dict[tuple[int, int], Sums]:
    """Sums of standardised statistics by (fold, label) over ``rows (fold, label, _x)``."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            z = np.clip((_matrix(batch.column(2)) - centre) / scale, -clip, clip)
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for key in set(zip(fold.tolist(), label.tolist())):
                own = z[(fold == key[0]) & (label == key[1])]
                one = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                held[key] = held[key] + one if key in held else one
        if held:
            yield pa.record_batch({"fold": pa.array([k[0] for k in held], pa.int32()), "label": pa.array([k[1] for k in held], pa.int32()),
                                   "sums": pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))})

    parts = rows.select("fold", "label", "_x").mapInArrow(released(run), "fold int, label int, sums array<double>")
    added = (parts.select("fold", "label", F.posexplode("sums").alias("at", "v")).groupBy("fold", "label", "at").agg(F.sum("v").alias("v"))
             .groupBy("fold", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v")))
    out = {}
    for r in added.collect():  # at most 2 x FOLDS rows
        v = np.array(r["v"])
        out[r["fold"], r["label"]] = Sums(v[0], v[1 : D + 1], v[D + 1 :].reshape(D, D))
    return out


def fitted(classes: list[Sums], pooled: float, diagonal: float, centre: np.ndarray, scale: np.ndarray) -> Discriminant:
    """The discriminant of two classes with their covariances shrunk."""
    means = [c.first / c.n for c in classes]
    own = [c.second / c.n - np.outer(m, m) for c, m in zip(classes, means)]
    common = sum(c.n * s for c, s in zip(classes, own)) / sum(c.n for c in classes)
    common = (1 - diagonal) * common + diagonal * np.diag(np.diag(common) + 1e-3)
    factors, logs = [], []
    for c, s in zip(classes, own):
        # few rows of a class lean further on the common covariance
        share = max(pooled, min(1.0, 2 * D / c.n))
        low = np.linalg.cholesky((1 - share) * s + share * common)
        factors.append(np.linalg.inv(low))
        logs.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(logs))


def _judged(rows: DataFrame, models: dict[tuple[int, int], Discriminant]) -> np.ndarray:
    """Histograms ``(candidate, label, bin)`` of the differences that the models of the
    other folds give ``rows (fold, label, _x)``."""
    candidates = 1 + max(c for _, c in models)

    def run(batches):
        counts = np.zeros((candidates, 2, BINS), np.int64)
        for batch in batches:
            x, fold, label = _matrix(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for (f, c), model in models.items():
                own = fold == f
                bins = np.clip(np.floor(model.difference(x[own]) / WIDTH) + BINS // 2, 0, BINS - 1).astype(int)
                for k in (0, 1):
                    counts[c, k] += np.bincount(bins[label[own] == k], minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.record_batch({"at": pa.array(at), "n": pa.array(counts.ravel()[at])})

    out = np.zeros(candidates * 2 * BINS)
    for r in rows.select("fold", "label", "_x").mapInArrow(released(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(candidates, 2, BINS)


def calibrated(counts: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift of the logistic of a histogram ``(label, bin)`` and the mean loss."""
    x = (np.arange(BINS) - BINS // 2 + 0.5) * WIDTH
    y, n = counts[1], counts.sum(axis=0)
    total = n.sum()
    a, b = 0.1, float(np.log((y.sum() + 1) / (total - y.sum() + 1)))

    def loss(a: float, b: float) -> float:
        # a slight pull of the slope keeps separable rows finite
        t = a * x + b
        return float((n * np.logaddexp(0, t) - y * t).sum() / total) + 1e-4 * a * a

    for _ in range(100):
        p = 0.5 * (1 + np.tanh((a * x + b) / 2))
        g = np.array([((n * p - y) * x).sum(), (n * p - y).sum()]) / total + np.array([2e-4 * a, 0])
        v = n * np.maximum(p * (1 - p), 1e-12) / total
        h = np.array([[(v * x * x).sum() + 2e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-9:
            break
    return max(a, 0.0), b, loss(a, b)


def learn(rows: DataFrame) -> Discriminant | float:
    """The discriminant of ``rows (fold, label, _x)``, or the share of label 1 (0 without
    rows) if they are of one class."""
    unit = sums(rows, np.zeros(D), np.ones(D), np.inf)
    both = [sum((s.n for (_, k), s in unit.items() if k == label), 0.0) for label in (0, 1)]
    if min(both) < 2:
        return both[1] / sum(both) if sum(both) else 0.0
    n = sum(both)
    centre = sum(s.first for s in unit.values()) / n
    spread = np.sqrt(np.maximum(np.diag(sum(s.second for s in unit.values())) / n - centre ** 2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    by = sums(rows, centre, scale)
    none = Sums(0.0, np.zeros(D), np.zeros((D, D)))
    whole = []
    for label in (0, 1):
        parts = [by.get((f, label), none) for f in range(FOLDS)]
        whole.append(Sums(sum(p.n for p in parts), sum(p.first for p in parts), sum(p.second for p in parts)))
    grid = [(p, d) for p in POOLED for d in DIAGONAL]
    models = {}
    for f in range(FOLDS):
        rest = [whole[k] - by.get((f, k), none) for k in (0, 1)]
        if min(r.n for r in rest) >= 2:
            for c, (p, d) in enumerate(grid):
                models[f, c] = fitted(rest, p, d, centre, scale)
    if not models:
        return fitted(whole, POOLED[-1], DIAGONAL[-1], centre, scale)
    fits = [calibrated(h) for h in _judged(rows, models)]
    best = min(range(len(grid)), key=lambda c: fits[c][2])
    model = fitted(whole, *grid[best], centre, scale)
    model.slope, model.shift, _ = fits[best]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label must not be learned (a null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
          carry: bool = False) -> DataFrame:
    """``(id, held_out, score, predicted)``, a row per row of ``docs``; with ``carry``
    all columns of ``docs`` come along instead of the id alone (a column of one of the
    new names is replaced).

    ``labels (id, quality)``: rows with a null id or label teach nothing; if an id is
    labelled more than once, its highest label holds; every row of a labelled id
    teaches.  Null and empty texts get the score of a text without words.  If the
    training rows are all of one class, every score is their share of label 1 (0
    without any)."""
    new = ("held_out", "score", "predicted")
    rest = [c for c in docs.columns if c not in new] if carry else [id_col]
    # the row travels as one struct, so that its names meet no other
    base = docs.select(F.struct(*rest).alias("_row"), F.col(text_col).alias("_text"))
    x = keep(measured(base, "_row", "_text"))
    known = (labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.max("quality").cast("int").alias("label")))
    slim = x.select(F.col(f"_row.`{id_col}`").alias(id_col), "_x").where(F.col(id_col).isNotNull() & ~held_out(id_col))
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(FOLDS)).cast("int")
    train = keep(slim.join(known, F.col(id_col) == F.col("_id")).where("label in (0, 1)").select(fold.alias("fold"), "label", "_x"))
    model = learn(train)

    def run(batches):
        for batch in batches:
            z = _matrix(batch.column(1))
            s = np.full(len(z), model) if isinstance(model, float) else model.score(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["_row", "score"])

    scored = x.mapInArrow(run, T.StructType([x.schema["_row"], T.StructField("score", T.DoubleType())]))
    out = scored.select("_row.*", "score")
    return out.select(*rest, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
