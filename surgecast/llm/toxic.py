"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features come from the text alone: densities of a fixed and of a learned lexicon,
nearness of lexicon words to words of address, capitals, punctuation and marks of
obfuscation.  Words are matched on a skeleton (letter look-alikes resolved, marks
inside words dropped), so ``id1ot`` and ``i.d.i.o.t`` count as the plain word.

Training rows are split by a hash of the id: one part teaches the lexicon, the
others the trees.  For the calibration, each half of those is judged by trees that
the other half taught, so none is judged by what it has taught.  They are a sample
of at most about ``SAMPLE`` labelled rows (chosen by the same hash).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .common import keep, released, text_bytes

SAMPLE = 40_000  # labelled rows to learn from, about
SAMPLE_PARTS = 6  # partitions of the sample's features
TREES, DEPTH = 20, 4
LEXICON_WORDS = 1000  # learned words at most
LEXICON_ROWS = 5  # toxic training texts a learned word stands in, at least
NEAR = 4  # words between a lexicon word and a word of address

# Insults and words of address, by language (en, de, fr, es).
INSULTS = """
idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown imbecile
dummkopf trottel arschloch depp abschaum widerlich erbärmlich wertlos
idiote imbécile crétin connard débile ordure minable dégoûtant
idiota imbécil estúpido estúpida basura escoria patético inútil asqueroso
""".split()
ADDRESS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted tus vosotros".split()

_LOOK_ALIKE = bytes.maketrans(b"01345789@$", b"oieastbgas")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$'")
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True

FEATURES = ["words", "fixed", "fixed_density", "learned", "learned_density", "learned_weight", "address_density", "near_address",
            "capitals", "shouted", "punctuation", "exclamations", "digits", "hidden", "inside_marks", "mean_word"]


def skeleton(text: bytes) -> bytes:
    return text.translate(_LOOK_ALIKE, _MARKS)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes that ``words.scan`` gives these words."""
    return np.sort(W.scan([" ".join(words).encode()]).hash) if words else np.zeros(0, np.uint64)


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


def _per(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.float64)))[first])


def features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and the feature columns, a row per row; null texts are empty."""
    fixed, address = word_hashes(INSULTS), word_hashes(ADDRESS)
    learned, weight = lexicon

    def run(batches):
        for batch in batches:
            out = [np.zeros((0, len(FEATURES)))]
            for _, texts in W.chunks(batch.column(len(id_cols)).to_pylist()):
                out.append(_features(texts, fixed, address, learned, weight))
            made = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[:, j]) for j in range(len(FEATURES)))],
                                             [*id_cols, *FEATURES])

    head = docs.select(*id_cols, text_bytes(text_col).alias("_b"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema.fields[:-1]] + [f"{f} double" for f in FEATURES])
    return head.mapInArrow(released(run), schema)


def _features(texts: list[bytes], fixed, address, learned, weight) -> np.ndarray:
    w, plain = W.scan([skeleton(t) for t in texts]), W.scan(texts)
    n = np.maximum(np.diff(w.first), 1).astype(float)
    is_fixed = _member(w.hash, fixed)
    is_learned = _member(w.hash, learned)
    is_address = _member(w.hash, address)
    gain = np.zeros(len(w.hash))
    if len(learned):
        gain[is_learned] = weight[np.searchsorted(learned, w.hash[is_learned])]
    # words since the last (until the next) word of address, within the chunk
    at = np.arange(len(w.hash))
    near = np.zeros(len(at), bool)
    if is_address.any():
        spots = np.flatnonzero(is_address)
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        for side in (np.searchsorted(spots, at) - 1, np.searchsorted(spots, at)):
            ok = (side >= 0) & (side < len(spots))
            other = spots[np.clip(side, 0, len(spots) - 1)]
            near |= ok & (np.abs(other - at) <= NEAR) & (doc[other] == doc)
    data, begin = plain.data, plain.at
    size = np.maximum(np.diff(begin) - 1, 1).astype(float)
    upper, letters = _per(_UPPER[data], begin), _per(_UPPER[data] | _LOWER[data], begin)
    runs = np.concatenate(([0], np.cumsum(_UPPER[data])))
    length = plain.end - plain.start
    shouted = (runs[plain.end] - runs[plain.start] == length) & (length > 1)
    marked = np.concatenate(([0], np.cumsum(_PUNCT[data] | _DIGIT[data])))
    lettered = np.concatenate(([0], np.cumsum(_LOWER[data] | _UPPER[data] | (data > 127))))
    inner = np.maximum(plain.end - 1, plain.start + 1)
    inside = (marked[inner] - marked[plain.start + 1] > 0) & (lettered[plain.end] - lettered[plain.start] > 1)
    words = np.maximum(np.diff(plain.first), 1).astype(float)
    # lexicon words that only the skeleton shows
    hidden = _per(is_fixed, w.first) - _per(_member(plain.hash, fixed), plain.first)
    return np.stack([
        np.log1p(np.diff(w.first)), _per(is_fixed, w.first), _per(is_fixed, w.first) / n, _per(is_learned, w.first),
        _per(is_learned, w.first) / n, _per(gain, w.first) / n, _per(is_address, w.first) / n, _per(near & (is_fixed | is_learned), w.first),
        upper / np.maximum(letters, 1), _per(shouted, plain.first) / words, _per(_PUNCT[data], begin) / size,
        _per(data == ord("!"), begin) / size, _per(_DIGIT[data], begin) / size, hidden, _per(inside, plain.first) / words,
        size / words], axis=1)


def learn_lexicon(rows: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Words (as hashes) that stand in more toxic than other texts of ``rows
    (text, toxic)``, with the log of how much more, less two standard errors; the ``LEXICON_WORDS``
    clearest."""

    def run(batches):
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for begin, texts in W.chunks(batch.column(0).to_pylist()):
                w = W.scan([skeleton(t) for t in texts])
                hashes.append(w.hash)
                owners.append(np.repeat(np.arange(len(texts)) + begin, np.diff(w.first)))
            h, o = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            h, hit = h[first], toxic[o[first]]
            value, which = np.unique(h, return_inverse=True)
            bad = np.bincount(which.reshape(-1), hit, len(value))
            yield pa.record_batch({"h": pa.array(value.view(np.int64)), "bad": pa.array(bad.astype(np.int64)),
                                   "good": pa.array((np.bincount(which.reshape(-1), minlength=len(value)) - bad).astype(np.int64))})

    total = rows.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad_rows, rows_n = total["bad"] or 0, total["n"]
    seen = (rows.select(text_bytes(text_col), "toxic").mapInArrow(released(run), "h long, bad long, good long")
            .groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= LEXICON_ROWS))
    gain = F.log((F.col("bad") + 0.5) / (bad_rows + 1.0)) - F.log((F.col("good") + 0.5) / (rows_n - bad_rows + 1.0))
    doubt = 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = seen.select("h", (gain - doubt).alias("gain")).where("gain > 0.5").orderBy(F.desc("gain"), "h").limit(LEXICON_WORDS).collect()
    h = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["gain"] for r in best], float)[order]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label must not be learned (a null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
          carry: bool = False) -> DataFrame:
    """``(id, held_out, score, predicted)``, a row per row of ``docs``; with ``carry``
    all columns of ``docs`` come along instead of the id alone (a column of one of
    the new names is replaced).

    ``labels (id, toxic)``: rows with a null id or label teach nothing; if an id is
    labelled more than once, its highest label holds.  Null and empty texts get the
    score of a text without words.  If the training rows are all of one class, every
    score is their share of toxic ones (0 without any).
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col)
             .agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(id_col)))
    known = keep(known)
    share = min(1.0, SAMPLE / max(known.count(), 1))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(10)).cast("int")
    # the sample is bounded, so it is broadcast and the texts stay where they are
    train = keep(docs.select(id_col, text_col).join(F.broadcast(known.where(draw)), id_col).withColumn("fold", fold))
    counts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")] if carry else [id_col]
    base = docs.select(*dict.fromkeys([*rest, text_col]), held_out(id_col).alias("held_out"))
    if len(counts) < 2:
        flat = 1.0 if counts.get(1) else 0.0
        out = base.select(*rest, "held_out", F.lit(flat).alias("score"))
    else:
        lexicon = learn_lexicon(train.where("fold < 3").select(text_col, "toxic"), text_col)
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="_x")
        made = keep(features(train.where("fold >= 3"), lexicon, ["toxic", "fold"], text_col))
        if made.select("toxic").distinct().count() < 2:  # few rows: all of them teach the trees too
            made = keep(features(train, lexicon, ["toxic", "fold"], text_col))
        made = made.coalesce(SAMPLE_PARTS)  # a bounded table, passed over once per tree level
        halves = [made.where("fold < 7"), made.where("fold >= 7")]
        trees = GBTClassifier(featuresCol="_x", labelCol="toxic", predictionCol="_p", maxIter=TREES, maxDepth=DEPTH,
                              stepSize=0.2, seed=7, minInstancesPerNode=5, checkpointInterval=-1)
        trees = trees.setProbabilityCol("_q").setRawPredictionCol("_r")

        def raw(model, df: DataFrame) -> DataFrame:
            return model.transform(assembler.transform(df)).withColumn("_s", vector_to_array("_q")[1])

        model = trees.fit(assembler.transform(made))
        judged = [raw(trees.fit(assembler.transform(seen)), other).select("toxic", "_s")
                  for seen, other in (halves, halves[::-1]) if seen.select("toxic").distinct().count() == 2]
        judged = judged[0].unionByName(judged[-1]) if judged else raw(model, made).select("toxic", "_s")
        steps = IsotonicRegression(featuresCol="_s", labelCol="toxic", predictionCol="_iso").fit(judged)
        edges, values = steps.boundaries.toArray(), steps.predictions.toArray()  # one per distinct score of the sample at most
        calibrated = _interpolate(F.col("_s"), edges, values)
        # a trace of the raw score keeps the order of texts on one step
        blended = calibrated * 0.99 + F.col("_s") * 0.01
        # carried columns stand in one struct, so that their names meet no feature
        boxed = base.select(F.struct(*rest, "held_out").alias("_row"), text_col)
        out = raw(model, features(boxed, lexicon, ["_row"], text_col)).select("_row.*", blended.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _interpolate(x: Column, edges: np.ndarray, values: np.ndarray) -> Column:
    """Piecewise linear function through the calibration points."""
    e, v = F.array(*map(F.lit, edges.tolist())), F.array(*map(F.lit, values.tolist()))
    i = F.size(F.filter(e, lambda y: y <= x))
    low, high = F.greatest(i, F.lit(1)), F.least(i + 1, F.lit(len(edges)))
    x0, x1 = F.element_at(e, low), F.element_at(e, high)
    y0, y1 = F.element_at(v, low), F.element_at(v, high)
    return F.when((x <= x0) | (x1 <= x0), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
