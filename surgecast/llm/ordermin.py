"""Document fingerprints by Order MinHash.

A text is the multiset of its ``WIDTH``-character k-mers; the n-th occurrence of
one counts as another element.  Each of ``COORDINATES`` hash orders selects the
``TUPLE`` least elements, puts them back in the order of the text and hashes the
tuple.  Two texts agree in a coordinate only if they share elements *and* their
order, so agreement falls with the edit distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import keep, partitions, released

WIDTH, TUPLE, COORDINATES = 8, 2, 32
_rng = np.random.default_rng(31337)
_MULT = _rng.integers(1, 2**31, (COORDINATES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROLE = _rng.integers(1, 2**63, TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = 24
_PIECE = 1 << 13  # elements whose orders are computed at once, to stay in cache


def fingerprint(points: np.ndarray) -> np.ndarray:
    """The ``COORDINATES`` 32-bit values of a text given as code points; zeros for an empty text."""
    n = len(points) - WIDTH + 1
    if not len(points):
        return np.zeros(COORDINATES, np.uint32)
    if n < 1:
        points, n = np.concatenate((points, np.zeros(WIDTH - len(points), np.uint32))), 1
    pw, inv = W._powers(len(points) + 1)
    total = np.empty(len(points) + 1, np.uint64)
    total[0] = 0
    np.cumsum((points.astype(np.uint64) + np.uint64(0x2545F491)) * np.uint64(0xD6E8FEB86659FD93) * pw[: len(points)], out=total[1:])
    h = (total[WIDTH:] - total[:-WIDTH]) * inv[:n]
    low = np.uint64((1 << _PLACE_BITS) - 1)
    if n <= low:
        key = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        place = (key & low).astype(np.int64)
        h = key & ~low
    else:
        h &= ~low
        place = np.argsort(h, kind="stable")
        h = h[place]
    new = np.ones(n, bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    base = h
    if not new.all():
        seen = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        base = h + seen.astype(np.uint64)  # the place bits are free for the occurrence
    base = (W.mix(base) >> np.uint64(32)).astype(np.uint32)
    want = min(TUPLE, n)
    best_v, best_i = [], []
    few = np.uint32(min(n, TUPLE + 14) * (2**32 - 1) // n)  # about so many elements lie below
    picked = np.empty((COORDINATES, want), np.int64)
    if n <= 4 * (TUPLE + 14):
        picked[:] = np.argsort(base[None, :] * _MULT, axis=1, kind="stable")[:, :want]
    else:
        for a in range(0, n, _PIECE):
            v = base[a : a + _PIECE][None, :] * _MULT
            flat = np.flatnonzero(v <= few)
            best_i.append((flat // v.shape[1], flat % v.shape[1] + a))
            best_v.append(v.reshape(-1)[flat])
        row = np.concatenate([r for r, _ in best_i])
        col, value = np.concatenate([c for _, c in best_i]), np.concatenate(best_v)
        order = np.argsort(row.astype(np.uint64) << np.uint64(32) | value, kind="stable")
        row, col = row[order], col[order]
        at = np.searchsorted(row, np.arange(COORDINATES + 1))
        for j in range(want):
            picked[:, j] = col[np.minimum(at[:-1] + j, len(col) - 1)] if len(col) else 0
        for j in np.flatnonzero(np.diff(at) < want):  # the guess was too low for this order
            picked[j] = np.argsort(base * _MULT[j], kind="stable")[:want]
    in_text = np.take_along_axis(picked, np.argsort(place[picked], axis=1), axis=1)
    value = (h[in_text] * _ROLE[:want]).sum(1, dtype=np.uint64) + np.uint64(want)
    return (W.mix(value + np.arange(COORDINATES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of coordinates in which two fingerprints agree."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_FIELDS = "n_chars long, edited binary, sign binary, edited_sign binary, near_edited double, near_next double"


def _compare(text: str, sign: np.ndarray, following: str, sign_following: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = sign if changed == text else fingerprint(code_points(changed))
    return (len(text), hashlib.sha256(changed.encode()).digest(), sign.tobytes(), other.tobytes(),
            likeness(sign, other), likeness(sign, sign_following))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``, a row per row.  The next document is the one of the next lower
    id (after the last, the first); rows of one id are ordered by a hash of their
    text, null ids are last.  Null texts are empty; two empty texts are alike (1).

    Rows are range-dealt by id and read in order; each partition hands the text of
    its first and last row to a join of partition neighbours.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.col(text_col))
    ordered = (docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), tie.alias("_tie"))
               .repartitionByRange(partitions(spark), F.col(id_col).desc(), F.col("_tie").desc())
               .sortWithinPartitions(F.col(id_col).desc(), F.col("_tie").desc()).select(id_col, "_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def run(batches):
        part, last, head = TaskContext.get().partitionId(), None, True
        for batch in batches:
            id_type, out = batch.column(0).type, []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sign = fingerprint(code_points(text))
                if head:
                    out.append((part, 1, text, name, None, None, sign.tobytes(), None, None, None))
                    head = False
                if last is not None:
                    out.append((part, 0, None, last[0], *_compare(last[1], last[2], text, sign)))
                last = (name, text, sign)
            yield table(out, id_type)
        if last is not None:
            yield table([(part, 2, last[1], last[0], len(last[1]), None, last[2].tobytes(), None, None, None)], id_type)

    def table(rows, id_type):
        kinds = [pa.int32(), pa.int32(), pa.string(), id_type, pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          ["part", "edge", "text", id_col, *names])

    done = keep(ordered.mapInArrow(released(run), f"part int, edge int, text string, `{id_col}` {kind}, {_FIELDS}"))
    parts = sorted(r["part"] for r in done.where("edge = 1").select("part").collect())  # one per partition
    turn = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, after int")
    heads = done.where("edge = 1").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("sign").alias("next_sign"))
    ends = done.where("edge = 2").select("part", "text", id_col, "sign").join(turn, "part").join(heads, "after")

    def finish(batches):
        for batch in batches:
            rows = [_compare(t, np.frombuffer(s, np.uint32), t2, np.frombuffer(s2, np.uint32))
                    for t, s, t2, s2 in zip(*(batch.column(c).to_pylist() for c in ("text", "sign", "next_text", "next_sign")))]
            kinds = [pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, *names])

    closed = ends.select(id_col, "text", "sign", "next_text", "next_sign").mapInArrow(released(finish), f"`{id_col}` {kind}, {_FIELDS}")
    both = done.where("edge = 0").select(id_col, *names).unionByName(closed)
    return both.select(id_col, "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), F.lower(F.hex("sign")).alias("fingerprint"),
                       F.lower(F.hex("edited_sign")).alias("edited_fingerprint"), "near_edited", "near_next")
