"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the places that a fixed mask selects in a
window; the other places may hold anything.  Seeds of the test items are joined
with seeds at every place of the training texts.  Around each hit the words of
the item and of the text are laid side by side, and the best stretch, with 1 for
an equal word and -1 for another, decides: substituted words cost, not hide.

The item table is joined map-side in slices of at most about ``SLICE_WORDS``
words, one after another over the same rows, so what is broadcast stays bounded
however large the benchmark is, and the texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from .common import released, text_bytes

MASKS = ("110010101", "101100011", "111000101", "100110110")
SPAN = len(MASKS[0])
SLICE_WORDS = 2_000_000
LONG_SCORE, SHORT_SCORE = 12, 8  # score that convicts, for long items and at least
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _plain(text: bytes) -> bytes:
    return text.translate(None, _PUNCTUATION)


def convicting(words: int) -> int:
    """Score that an item of so many words needs: about half its words, between
    ``SHORT_SCORE`` and ``LONG_SCORE``, and no more than it has."""
    return min(words, max(SHORT_SCORE, min(LONG_SCORE, words // 2)))


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Seed of every window that starts in ``h`` (windows run over the end of a text; see ``_valid``)."""
    n = len(h) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return W.mix(out)


class Index:
    """Seeds of a slice of items."""

    def __init__(self, ids: list, texts: list[bytes]):
        w = W.scan([_plain(t) for t in texts]) if texts else W.scan([b""])
        self.ids, self.first, self.hash = ids, w.first, w.hash
        self.data, self.start, self.end = W.lowered(w.data), w.start, w.end
        self.length = np.diff(w.first)
        self.masks: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for mask in [*MASKS, *("1" * int(n) for n in np.unique(self.length) if 0 < n < SPAN)]:
            value = _seeds(w.hash, mask)
            if mask in MASKS:
                place = np.flatnonzero(_valid(w.first, len(mask), len(value)))
            else:  # an item shorter than a mask is one seed
                place = w.first[:-1][self.length == len(mask)]
            order = np.argsort(value[place], kind="stable")
            self.masks[mask] = (value[place][order], place[order])
        self.item_of = np.repeat(np.arange(len(self.length)), self.length)

    def search(self, texts: list[bytes]) -> list[dict[int, tuple[int, int]]]:
        """For every text, item number -> (best score, first word) of what convicts."""
        w = W.scan([_plain(t) for t in texts])
        doc_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
        pairs = []
        for mask, (table, place) in self.masks.items():
            value = _seeds(w.hash, mask)
            if not len(value) or not len(table):
                continue
            low = np.searchsorted(table, value, "left")
            hit = table[np.minimum(low, len(table) - 1)] == value
            hit &= _valid(w.first, len(mask), len(value))
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            low = low[at]
            many = np.searchsorted(table, value[at], "right") - low
            text_at = np.repeat(at, many)
            item_at = place[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            # one diagonal of a text and an item is looked at once
            pairs.append(np.stack([doc_of[text_at], self.item_of[item_at], text_at - item_at], axis=1))
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not pairs:
            return out
        data = W.lowered(w.data)
        for d, i, shift in np.unique(np.concatenate(pairs), axis=0).tolist():
            a = max(self.first[i], w.first[d] - shift)
            b = min(self.first[i + 1], w.first[d + 1] - shift)
            same = self.hash[a:b] == w.hash[a + shift : b + shift]
            like = np.flatnonzero(same)  # of one hash: are they of one spelling?
            same[like] = W.equal(self.data, self.start[a + like], self.end[a + like], data, w.start[a + shift + like], w.end[a + shift + like])
            total = np.concatenate(([0], np.cumsum(np.where(same, 1, -1))))
            best = int((total - np.minimum.accumulate(total)).max())
            if best >= convicting(int(self.length[i])) and best > out[d].get(i, (0, 0))[0]:
                out[d][i] = (best, int(a + shift - w.first[d]))
        return out


def _valid(first: np.ndarray, span: int, n: int) -> np.ndarray:
    """Windows of ``span`` words that lie inside one text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:n] == doc[span - 1 : span - 1 + n]


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: an array of ``(item, score, at)``, the item, the score
    of its best stretch and the word of the text where the item begins, by item.

    Null and empty texts and items have no words and match nothing; repeated rows
    are judged alike; a benchmark column may have any name (only its id and text
    are read).  A column ``leaks`` of ``docs`` is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), text_bytes(item_text).alias("t"))
    n_words = F.size(F.split(F.col("t").cast("string"), r"[\x20\x09-\x0D]+"))
    slices = max(1, -(-(items.agg(F.sum(n_words)).first()[0] or 0) // SLICE_WORDS))
    kind = items.schema["i"].dataType
    leak = T.ArrayType(T.StructType([T.StructField("item", kind), T.StructField("score", T.IntegerType()), T.StructField("at", T.IntegerType())]))
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(leak))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).orderBy("i", "t").collect()
        table = spark.sparkContext.broadcast(Index([r["i"] for r in part], [bytes(r["t"]) for r in part]))
        out = out.mapInArrow(released(_search(table, out.columns.index(text_col))), out.schema)
    return out


def _search(table, text_at: int):
    def run(batches):
        index = table.value
        for batch in batches:
            found = []
            texts = batch.column(text_at).to_pylist()
            for _, run_ in W.chunks(texts):
                for hits in index.search(run_):
                    found.append([{"item": index.ids[i], "score": s, "at": a} for i, (s, a) in sorted(hits.items())])
            before = batch.column(batch.num_columns - 1).to_pylist()
            merged = pa.array([[*b, *f] for b, f in zip(before, found)], batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], merged], batch.schema.names)

    return run
