"""Dedup of repeated lines by content-defined chunks, and of repeated stretches of words.

*Chunks.*  Every line with words is hashed.  A rolling hash over the hashes of a line and
the one before it (nothing, for the first of a text) chooses the chunk ends: a chunk
ends where it is less than its neighbours, so chunks have two lines and more, and where
they end depends on the lines nearby alone.  A chunk of several lines that stands at an
earlier place of the corpus (smaller id, then place) goes, and so do the lines before
and behind it, one by one, as long as they equal those at the earlier place.

*Stretches.*  A passage inside a line, or in lines wrapped otherwise, shares no line with
its copy.  So a stretch of ``least`` words that stands at an earlier place goes as well,
word for word up to where the texts differ.  Every window of ``least`` words is named by
the least hash of the runs of ``least // 3`` words inside it (winnowing).  The name
depends on the window's words alone, so equal windows have one name whatever stands
around them, and no window is left out.  Neighbouring windows mostly share their name
and travel as one segment:

* only names are counted over the corpus, by ranges of hashes.  Chunks and segments
  move whose name passes a filter of repeated names; the filter has a fixed size and
  lets too much pass when it is full, never too little;
* chunks and segments of one name and one hash of all their words match as a whole;
* where a name has several such hashes (near the ends of a repeated stretch), the
  first segment of each is taken apart and its windows are matched, all of a name
  together; a name of very many such segments has its windows dealt out one by one.

*Bytes.*  Hashes only say where to look.  The bytes of each earlier place are fetched
from its text and compared, word by word, with those that would go; what differs stays.
White space between words is not compared, line ends of chunks are.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from ..sources.sinks import remove_path
from . import words as W
from .common import keep, partitions, prepare, released

LEAST_WORDS = 30  # words of a repeated stretch that goes
FILTER_BITS = 26  # log2 of the bits of the filter of repeated names: 8 MB
SALTS = 64  # a place that many texts repeat is handed out in as many rows
SEND_NAMES = 1 << 18  # names that a task sorts and sends at once
MANY = 1000  # segments of one name from which their windows are dealt out over tasks


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        value, have = np.minimum(value[:-have], value[have:]), 2 * have
    more = width - have
    return np.minimum(value[:-more], value[more:]) if more else value


class Runs:
    """Hashes of runs of neighbouring items, from hashes of runs of 1, 2, 4, ... of them;
    every step mixes, so no pattern of items makes unequal runs alike."""

    def __init__(self, item: np.ndarray):
        self._level = [item]

    def _power(self, k: int) -> np.ndarray:
        while len(self._level) <= k:
            x, half = self._level[-1], 1 << (len(self._level) - 1)
            self._level.append(_pair(x[: max(0, len(x) - half)], x[half:], 2 * half))
        return self._level[k]

    def every(self, size: int) -> np.ndarray:
        """Of all runs of ``size``."""
        k = size.bit_length() - 1
        x = self._power(k)
        return _pair(x[: max(0, len(x) - (size - (1 << k)))], x[size - (1 << k) :], size)

    def at(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the runs of some sizes from some places on."""
        out = np.zeros(len(start), np.uint64)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            x, first, more = self._power(k), start[rows], size[rows] - (1 << k)
            out[rows] = _pair(x[first], x[first + more], size[rows].astype(np.uint64))
        return out


def _pair(left: np.ndarray, right: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    x = left >> np.uint64(29)
    x ^= left
    x *= np.uint64(W._BASE)
    x += right
    x += size if isinstance(size, np.ndarray) else np.uint64(size)
    return W.mix(x)


class Segments:
    """Runs of neighbouring windows of one name, of all texts: ``name``, ``first`` (word
    at which the first window begins), ``count`` of windows, ``owner`` (text)."""

    def __init__(self, w: W.Words, words: Runs, least: int):
        n, gram = len(w.hash), max(1, least // 3)
        width, windows = least - gram + 1, max(0, n - least + 1)
        self._words, self.least = words, least
        self.name, self.first, self.count, self.owner = np.zeros(0, np.uint64), *np.zeros((3, 0), np.int64)
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        at = np.flatnonzero(doc[:windows] == doc[n - windows :])  # windows within one text
        if not len(at):
            return
        low = _sliding_least(words.every(gram), width)[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[at[1:]] != doc[at[:-1]])
        begin = np.flatnonzero(new)
        place = np.arange(len(at)) - begin[np.cumsum(new) - 1]
        begin = np.flatnonzero(place % width == 0)  # a periodic text has many windows of one name
        self.name, self.first, self.owner = low[begin], at[begin], doc[at[begin]]
        self.count = np.diff(np.append(begin, len(at)))

    def windows(self, rows: np.ndarray) -> pa.ListArray:
        """The hash of each window of some segments."""
        count = self.count[rows]
        offset = np.concatenate(([0], np.cumsum(count)))
        start = np.repeat(self.first[rows] - offset[:-1], count) + np.arange(offset[-1])
        return pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(self._words.every(self.least)[start].view(np.int64)))


class Chunks:
    """Chunks of two and more lines with words, of all texts: ``name`` (of the lines),
    ``whole`` (of the words), ``first`` word, ``size`` in words, ``owner`` (text)."""

    def __init__(self, w: W.Words):
        n = len(w.start)
        self.name, self.whole = np.zeros((2, 0), np.uint64)
        self.first, self.size, self.owner = np.zeros((3, 0), np.int64)
        begin = np.unique(np.concatenate(([0], np.searchsorted(w.start, np.flatnonzero(w.data == ord("\n"))))))
        begin = begin[begin < n]  # first word of every line; texts end in a line end
        if not len(begin):
            return
        text = np.searchsorted(w.first, begin, "right") - 1
        edge = np.append(begin, n)
        place = np.arange(n, dtype=np.uint64)  # of each word in its line
        place -= np.repeat(begin.astype(np.uint64), np.diff(edge))
        place *= np.uint64(W._BASE)
        place += w.hash
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(W.mix(place), out=total[1:])
        line = W.mix(total[edge[1:]] - total[begin])
        first = np.flatnonzero(chunk_ends(line, text)) + 1
        first, end = np.concatenate(([0], first[:-1])), first
        some = end - first > 1
        first, end = first[some], end[some]
        self.name = Runs(line).at(first, end - first)
        self.first, self.owner = begin[first], text[first]
        self.size = edge[end] - self.first
        self.whole = total[edge[end]] - total[self.first]


def chunk_ends(line: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a chunk ends behind each line, from the lines' hashes and their texts."""
    same = text[1:] == text[:-1]
    before = np.zeros(len(line), np.uint64)  # every text begins with the same state
    before[1:][same] = line[:-1][same]
    rolling = _pair(before, line, 2)
    end = np.ones(len(line), bool)
    falls = np.zeros(len(line), bool)
    falls[1:] = same & (rolling[1:] < rolling[:-1])
    end[:-1] = ~same | (falls[:-1] & (rolling[:-1] <= rolling[1:]))
    return end


def _filter(repeated: DataFrame) -> np.ndarray:
    """Bits of the hashes ``h``, as bytes; as many rows as it has 64-bit words come here."""
    slot = f"shiftrightunsigned(h, {64 - FILTER_BITS})"
    rows = repeated.select(F.expr(f"shiftright({slot}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit"))
    return _bits(rows.groupBy("word").agg(F.bit_or("bit").alias("bits")))


def _bits(words: DataFrame) -> np.ndarray:
    rows = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    np.bitwise_or.at(out, rows["word"].to_numpy(), rows["bits"].to_numpy())
    return out


def _sent(h: np.ndarray, parts: int) -> pa.RecordBatch:
    """Sorted hashes by ranges, as bytes; those that stand there more than once, twice."""
    value, n = np.unique(h, return_counts=True)
    value = np.repeat(value, np.minimum(n, 2))
    part = ((value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    edge = np.append(at, len(value)).tolist()
    return pa.record_batch({"part": pa.array(part[at]), "h": pa.array([value[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())})


def _repeated(batches):
    """The words of the filter of all hashes that came twice and more, of some ranges."""
    h = [np.frombuffer(x, np.uint64) for batch in batches for x in batch.column(1).to_pylist()]
    value = np.sort(np.concatenate([np.zeros(0, np.uint64), *h]))
    slot = (value[1:][value[1:] == value[:-1]] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    word = slot >> 6
    at = np.flatnonzero(np.diff(word, prepend=-1))
    bits = np.bitwise_or.reduceat(np.int64(1) << (slot & 63), at) if len(at) else np.zeros(0, np.int64)
    yield pa.record_batch({"word": pa.array(word[at]), "bits": pa.array(bits)})


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def _place(word: Column | str) -> Column:
    return F.struct(F.col("id").isNull().alias("late"), "id", "key", (F.col(word) if isinstance(word, str) else word).alias("word"))


def _gone(matched: DataFrame, least: int) -> DataFrame:
    """Word ranges of rows that have an earlier place ``f``, and how many words before
    them (``shift``) that place is in its text; of a stretch that overlaps its own first
    occurrence (a periodic text), only what is past that one."""
    own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key"))
    return (matched.where(~(own & (F.col("word") == F.col("f.word"))))
            .select("id", "key", "lines", F.col("f.id").alias("fid"), F.col("f.key").alias("fkey"), (F.col("word") - F.col("f.word")).alias("shift"),
                    F.when(own & ~F.col("lines"), F.greatest("word", F.col("f.word") + least)).otherwise(F.col("word")).alias("lo"),
                    (F.col("word") + F.col("n")).alias("hi")).where("lo < hi"))


def _by_runs(batches, by: int):
    """The rows of sorted batches, cut where the column ``by`` changes."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        h = batch.column(by).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(h[1:] != h[:-1]) + 1
        if left and len(h) and h[0] != left[-1].column(by)[-1].as_py():
            new = np.append(0, new)
        if not len(new):
            left += [batch] if len(h) else []
            continue
        yield _as_one([*left, batch.slice(0, new[-1])])
        left = [batch.slice(new[-1])]
    if left:
        yield _as_one(left)


def _as_one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) for c in table.columns], schema=table.schema)


def _merged(gone: DataFrame, kind: str) -> DataFrame:
    """Ranges that meet, of one text and one earlier place, as one.  A chunk that meets a
    stretch there is part of a stretch, as are equal lines around it; not so within a
    text, where of stretches only what is past the first occurrence goes."""
    def run(batches):
        for batch in _by_runs(batches, 8):
            key, lines, fkey, shift, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5, 6, 7))
            codes = pa.chunked_array([batch.column(0), batch.column(3)]).combine_chunks().dictionary_encode().indices
            id_, fid = np.split(codes.fill_null(-1).to_numpy(zero_copy_only=False), 2)
            of = (lines & (id_ == fid) & (key == fkey), shift, fkey, fid, key, id_)
            order = np.lexsort((hi, lo, *of))
            lo, hi = lo[order].astype(np.int64), hi[order].astype(np.int64)
            new = np.zeros(len(order), bool)
            for x in of:
                new |= np.diff(x[order].astype(np.int64), prepend=0) != 0
            new[0] = True
            base = np.cumsum(new) << 32
            new[1:] |= lo[1:] + base[1:] > np.maximum.accumulate(hi + base)[:-1]
            at = np.flatnonzero(new)
            rows = pa.array(order[at])
            yield pa.record_batch({c: batch.column(i).take(rows) for c, i in (("id", 0), ("key", 1), ("fid", 3), ("fkey", 4), ("shift", 5))}
                                  | {"lo": pa.array(lo[at].astype(np.int32)), "hi": pa.array(np.maximum.reduceat(hi, at).astype(np.int32)),
                                     "lines": pa.array(np.logical_and.reduceat(lines[order], at))})

    return (gone.select("id", "key", "lines", "fid", "fkey", "shift", "lo", "hi").repartition("id", "key")
            .withColumn("h", F.xxhash64("id", "key")).sortWithinPartitions("h")
            .mapInArrow(released(run), f"id {kind}, key long, fid {kind}, fkey long, shift int, lo int, hi int, lines boolean"))


def _window_runs(kinds: DataFrame, least: int, kind: str) -> DataFrame:
    """Runs of windows that stand at an earlier place of the segments of their name."""
    def run(batches):
        for batch in _by_runs(batches, 0):
            name, word = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            offset = batch.column(5).offsets.to_numpy()
            window = batch.column(5).values.to_numpy()[offset[0] : offset[-1]]
            if not len(window):
                continue
            row = np.repeat(np.arange(len(name)), np.diff(offset))
            at = np.arange(len(row)) - (offset - offset[0])[row] + word[row]
            which = pd.factorize(window)[0] * len(name) + np.cumsum(np.diff(name, prepend=name[0]) != 0)[row]
            _, first, inverse = np.unique(which, return_index=True, return_inverse=True)
            f = first[inverse]  # rows come by their places
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1] + 1) | (row[f[1:]] != row[f[:-1]]) | (f[:-1] == np.arange(len(f) - 1))
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(row))) + (least - 1)
            some = f[begin] != begin
            begin, n = begin[some], n[some]
            mine, other = pa.array(row[begin]), pa.array(row[f[begin]])
            yield pa.record_batch({"id": batch.column(2).take(mine), "key": batch.column(3).take(mine), "word": pa.array(at[begin].astype(np.int32)),
                                   "n": pa.array(n.astype(np.int32)), "fid": batch.column(2).take(other), "fkey": batch.column(3).take(other),
                                   "fword": pa.array(at[f[begin]].astype(np.int32))})

    rows = (kinds.select("name", "p.late", "p.id", "p.key", "p.word", "windows").repartition("name")
            .sortWithinPartitions("name", "late", "id", "key", "word"))
    found = rows.mapInArrow(released(run), f"id {kind}, key long, word int, n int, fid {kind}, fkey long, fword int")
    return found.select("id", "key", "word", "n", F.lit(False).alias("lines"),
                        F.struct(F.col("fid").alias("id"), F.col("fkey").alias("key"), F.col("fword").alias("word")).alias("f"))


def _earlier_bytes(source: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """The bytes of the word ranges ``from``, ``to`` of the texts ``fid``, ``fkey``, with
    the white space around them; a line end stands for either end of the text."""
    cut = F.struct("from", "to", "salt")
    both = (asked.select(F.col("fid").alias("id"), F.col("fkey").alias("key"), cut.alias("cut"), F.lit(None).cast("binary").alias("b"))
            .unionByName(source.select("id", "key", F.lit(None).alias("cut"), "b")))
    texts = both.groupBy("id", "key").agg(F.collect_set("cut").alias("cuts"), F.first("b", ignorenulls=True).alias("b")).where("size(cuts) > 0")

    def run(batches):
        for batch in batches:
            cuts, keys = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)
            offset, flat = cuts.offsets.to_numpy(), cuts.values
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for begin, texts in W.chunks(batch.column(3).to_pylist()):
                w = W.scan(texts, fold=False)
                a, b = offset[begin], offset[begin + len(texts)]
                text = np.repeat(np.arange(len(texts)), np.diff(offset[begin : begin + len(texts) + 1]))
                first, last = w.first[text], w.first[text + 1]
                x, y = np.minimum(first + lo[a:b], last), np.minimum(first + hi[a:b], last)
                start, end = np.append(w.start, 0), np.append(w.end, 0)
                left = np.where(x > first, end[x - 1], w.at[text] - 1) + 1
                right = np.where(y < last, start[y], w.at[text + 1]) + 1
                raw = b"\n" + w.data.tobytes()  # so every text has a line end on either side
                piece = [raw[i:j] for i, j in zip(left.tolist(), right.tolist())]
                rows = pa.array(text + begin)
                yield pa.record_batch({"pid": batch.column(0).take(rows), "pkey": pa.array(keys[text + begin]), "pfrom": flat.field(0)[a:b],
                                       "pto": flat.field(1)[a:b], "psalt": flat.field(2)[a:b], "piece": pa.array(piece, pa.binary())})

    return texts.mapInArrow(released(run), f"pid {kind}, pkey long, pfrom int, pto int, psalt int, piece binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated chunks of lines and stretches of words taken out of the
    text, and ``removed_words``.

    A row per row.  Rows of one id and one text are one document (they stay alike);
    of several texts under one id each counts for itself.  Null and empty texts stay
    as they are; a null id is after all others.  A text of which only white space
    would be left becomes empty.  Of what is repeated within a line or in single lines,
    stretches of fewer than ``least`` words stay; chunks of lines go at any length.  A column ``removed_words`` of ``docs`` is replaced.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("binary").alias("b")).where("b is not null")

    parts = partitions(spark)

    def names(batches):
        h: list[np.ndarray] = []
        for batch in batches:
            for _, texts in W.chunks(batch.column(0).to_pylist()):
                w = W.scan(texts, fold=False)
                h += [Segments(w, Runs(w.hash), least).name, Chunks(w).name]
            if sum(map(len, h)) >= SEND_NAMES:
                yield _sent(np.concatenate(h), parts)
                h = []
        yield _sent(np.concatenate([np.zeros(0, np.uint64), *h]), parts)

    sent = source.select("b").mapInArrow(released(names), "part int, h binary").repartitionById(parts, F.col("part"))
    bits = spark.sparkContext.broadcast(_bits(sent.mapInArrow(released(_repeated), "word long, bits long")))

    def one_of(keys: DataFrame):
        """A test that the keys of ``h`` pass, and few others."""
        marks = spark.sparkContext.broadcast(_filter(keys))

        @F.pandas_udf("boolean")
        def maybe(k: pd.Series) -> pd.Series:
            return pd.Series(_passes(marks.value, k.to_numpy().view(np.uint64)))

        return maybe

    def found(source, known, windows: bool):
        """Segments whose name passes the filter ``known``: with the hashes of their
        windows, or without and then chunks as well."""
        def run(batches):
            for batch in batches:
                ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
                for begin, texts in W.chunks(batch.column(2).to_pylist()):
                    w = W.scan(texts, fold=False)
                    words = Runs(w.hash)
                    s = Segments(w, words, least)
                    rows = np.flatnonzero(_passes(known.value, s.name))
                    name, own, first, n = s.name[rows], s.owner[rows], s.first[rows], s.count[rows] + (least - 1)
                    whole = words.at(first, n)
                    if not windows:
                        c = Chunks(w)
                        more = np.flatnonzero(_passes(known.value, c.name))
                        name, whole, own, first, n = (np.concatenate((x, y[more])) for x, y in
                                                      ((name, c.name), (whole, c.whole), (own, c.owner), (first, c.first), (n, c.size)))
                    if not len(name):
                        continue
                    out = {"name": pa.array(name.view(np.int64)), "whole": pa.array(whole.view(np.int64)),
                           "id": ids.take(pa.array(own + begin)), "key": pa.array(keys[own + begin]),
                           "word": pa.array((first - w.first[own]).astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                           "lines": pa.array(np.arange(len(name)) >= len(rows))}
                    yield pa.record_batch(out | ({"windows": s.windows(rows)} if windows else {}))

        return source.mapInArrow(released(run), f"name long, whole long, id {kind}, key long, word int, n int, lines boolean" + ", windows array<long>" * windows)

    path = scratch_path(spark, "line-segments")  # written, as it is read several times; gone once the ranges are kept
    found(source, bits, False).write.parquet(path)
    segments = spark.read.parquet(path)
    firsts = segments.groupBy("name", "whole").agg(F.min(_place("word")).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    as_whole = _gone(segments.join(firsts, ["name", "whole"]), least)

    several = segments.where("not lines").groupBy("name").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    apart = spark.sparkContext.broadcast(_filter(several.select(F.col("name").alias("h"))))

    def owners(batches):
        for batch in batches:
            yield pa.record_batch({"h": pc.unique(batch.column(1).filter(pa.array(_passes(apart.value, batch.column(0).to_numpy().view(np.uint64)))))})

    has_some = one_of(segments.where("not lines").select("name", "key").mapInArrow(released(owners), "h long"))
    kinds = keep(found(source.where(has_some("key")), apart, True).groupBy("name", "whole").agg(F.min(_place("word")).alias("p"), F.first("windows").alias("windows"))
                 .select("name", "p", "windows"))
    crowded = one_of(kinds.groupBy(F.col("name").alias("h")).count().where(F.col("count") >= MANY))
    by_name = _gone(_window_runs(kinds.where(~crowded("name")), least, kind), least)
    single = (kinds.where(crowded("name")).select("name", "p.id", "p.key", F.col("p.word").alias("at"), F.posexplode("windows").alias("j", "window"))
              .select("name", "window", "id", "key", (F.col("at") + F.col("j")).alias("word")))
    earliest = single.groupBy("name", "window").agg(F.min(_place("word")).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    one_by_one = _gone(single.join(earliest, ["name", "window"]).select("*", F.lit(least).alias("n"), F.lit(False).alias("lines")), least)

    # chunks ask for the lines around as well: where more than these are equal, there is a stretch of ``least`` words
    around = F.when(F.col("lines"), least - 1).otherwise(0)
    asked = keep(_merged(as_whole.unionByName(by_name).unionByName(one_by_one), kind)
                 .select("*", F.greatest(F.col("lo") - F.col("shift") - around, F.lit(0)).alias("from"), (F.col("hi") - F.col("shift") + around).alias("to"),
                         F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int").alias("salt")))
    remove_path(spark, path)

    first_texts = source.where(one_of(asked.select(F.col("fkey").alias("h")))("key"))
    earlier = _earlier_bytes(first_texts, asked, kind)
    ranges = (asked.join(earlier, F.col("fid").eqNullSafe(F.col("pid")) & (F.col("fkey") == F.col("pkey")) & (F.col("from") == F.col("pfrom"))
                         & (F.col("to") == F.col("pto")) & (F.col("salt") == F.col("psalt")))
              .groupBy("id", "key")
              .agg(F.collect_list(F.struct("lo", "hi", "lines", (F.col("lo") - F.col("shift") - F.col("from")).alias("at"), "piece")).alias("_ranges"))
              .withColumnsRenamed({"id": "_rid", "key": "_rkey"}))
    # texts that surely keep everything stay where they are; the others meet their ranges
    columns = [c for c in docs.columns if c != "removed_words"]
    maybe = one_of(asked.select(F.col("key").alias("h")))
    keyed = docs.select(*columns, key.alias("_key")).withColumn("_maybe", maybe("_key"))
    whole = keyed.where("not _maybe").select(*columns, F.lit(0).alias("removed_words"))
    joined = (keyed.where("_maybe")
              .join(ranges, F.col(id_col).eqNullSafe(F.col("_rid")) & (F.col("_key") == F.col("_rkey")), "left").select(*columns, "_ranges"))
    schema = docs.select(*columns).withColumn("removed_words", F.lit(0)).schema
    text_at = columns.index(text_col)

    def remove(batches):
        for batch in batches:
            texts, ranges_ = batch.column(text_at).to_pylist(), batch.column(len(columns))
            at, flat = ranges_.offsets.to_pylist(), ranges_.values
            fields = [flat.field(i).slice(at[0], at[-1] - at[0]).to_pylist() for i in range(flat.type.num_fields)]
            rows = [dict(zip(flat.type.names, x)) for x in zip(*fields)]
            spans = [rows[i - at[0] : j - at[0]] for i, j in zip(at, at[1:])]
            out, gone = list(texts), np.zeros(len(texts), np.int32)
            some = [i for i, s in enumerate(spans) if s]
            for begin, raw in W.chunks([texts[i] for i in some]):
                w = W.scan(raw, fold=False)
                for j, (i, b) in enumerate(zip(some[begin:], raw)):
                    words = slice(w.first[j], w.first[j + 1])
                    out[i], gone[i] = without(texts[i], b, w.start[words] - w.at[j], w.end[words] - w.at[j], spans[i], least)
            arrays = list(batch.columns[:-1])
            arrays[text_at] = pa.array(out, arrays[text_at].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone)], [*columns, "removed_words"])

    return joined.mapInArrow(released(remove), schema).unionByName(whole)


def equal_words(mine: bytes, piece: bytes, least: int) -> list[tuple[int, int]]:
    """The word ranges in which both hold the same bytes, white space aside: all, or runs
    of ``least`` words and more."""
    a, b = mine.split(), piece.split()
    if a == b:
        return [(0, len(a))]
    return [r for r in _runs([x == y for x, y in zip(a, b)]) if r[1] - r[0] >= least]


def equal_lines(lines: list[list[bytes]], first: list[int], lo: int, hi: int, piece: bytes, at: int) -> list[tuple[int, int]]:
    """Word ranges of a text of these lines (``first``: the words before each, and in all)
    that equal lines of ``piece``, which holds a chunk ``at`` words on and lines around it:
    two lines and more of the chunk at ``lo:hi``, and those that follow on either side."""
    parts = piece.split(b"\n")
    other = [words for line in parts[1:-1] if (words := line.split())]  # those at both ends are not whole
    skip, k = at - len(parts[0].split()), 0
    while skip > 0 and k < len(other):
        skip, k = skip - len(other[k]), k + 1
    begin, end = bisect_left(first, lo), bisect_left(first, hi)
    from_ = begin - min(begin, k)
    same = [x == y for x, y in zip(lines[from_:], other[k - (begin - from_) :])]
    return [(first[from_ + a], first[from_ + b]) for a, b in _runs(same) if min(from_ + b, end) - max(from_ + a, begin) > 1]


def _runs(same: list[bool]) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.array(same, np.int8), [0])))).tolist()
    return list(zip(edge[0::2], edge[1::2]))


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], hi))
        else:
            merged.append((lo, hi))
    return merged


def without(text: str, raw: bytes, start: np.ndarray, end: np.ndarray, spans: list[dict], least: int = LEAST_WORDS) -> tuple[str, int]:
    """The text, whose bytes are ``raw`` and whose words stand at ``start:end``, without
    what equals the bytes of the earlier places in ``spans``, and the number of words gone."""
    stretches, chunks, lines, first = [], [], None, None
    for s in spans:
        lo, hi, n = s["lo"], s["hi"], len(start)
        if hi > n:  # another text of the same id and hash
            continue
        if not s["lines"]:
            mine = raw[start[lo] : end[hi - 1]]
            if mine == s["piece"].strip():
                stretches.append((lo, hi))
            else:
                stretches += [(lo + a, lo + b) for a, b in equal_words(mine, s["piece"], least)]
            continue
        if lines is None:
            lines = [words for line in raw.split(b"\n") if (words := line.split())]
            first = np.cumsum([0, *map(len, lines)]).tolist()
        chunks += equal_lines(lines, first, lo, hi, s["piece"], s["at"])
    ranges = _union([r for r in _union(stretches) if r[1] - r[0] >= least] + chunks)
    if not ranges:
        return text, 0
    out, at = [], 0
    for lo, hi in ranges:
        out.append(raw[at : end[lo - 1] if lo else 0])
        at = int(end[hi - 1])
    out.append(raw[at:])
    left = b"".join(out)
    return ("" if not left.strip() else left.decode()), sum(hi - lo for lo, hi in ranges)
