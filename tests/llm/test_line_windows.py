"""Line dedup: names counted by ranges, windows matched by name, ranges merged text by text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from surgecast.llm import linededup

from .common import frame
from .test_dedup import own_words
from .test_line_chunks import left_by_brute_force


def test_names_go_out_by_ranges():
    """Few rows whatever the number of names; each name in one range, twice where it is repeated."""
    h = np.random.default_rng(5).integers(0, 2**64, 5000, dtype=np.uint64)
    sent = [linededup._sent(x, 7) for x in (np.append(h[:3000], h[:3]), h[2990:], h[:0])]
    assert [b.num_rows for b in sent] == [7, 7, 0]
    parts = [pa.record_batch({"part": [p] * len(x), "h": x}) for p in range(7)
             if (x := [r["h"] for b in sent for r in b.to_pylist() if r["part"] == p])]
    bits = np.zeros(1 << (linededup.FILTER_BITS - 6), np.int64)
    for p in parts:
        for b in linededup._repeated([p]):
            np.bitwise_or.at(bits, b["word"].to_numpy(), b["bits"].to_numpy())
    repeated = np.unique(np.append(h[:3], h[2990:3000]))
    assert linededup._passes(bits, repeated).all()
    assert sum(bin(x & (2**64 - 1)).count("1") for x in bits[bits != 0].tolist()) == len(repeated)


def test_sorted_batches_are_cut_where_the_key_changes():
    rng = random.Random(4)
    rows = sorted(rng.randrange(12) for _ in range(200))
    for size in (1, 3, 50, 500):
        batches = [pa.record_batch({"h": rows[i : i + size]}) for i in range(0, len(rows), size)]
        got = [b.column(0).to_pylist() for b in linededup._by_runs(batches, 0)]
        assert sum(got, []) == rows and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
    assert not list(linededup._by_runs([], 0))


@pytest.mark.parametrize("many", [1, 4, 1000])
def test_windows_by_name_and_one_by_one(spark, monkeypatch, many):
    """Passages inside lines, cut anywhere, of many texts, one of them periodic: names of
    few segments and of many give what brute force gives."""
    monkeypatch.setattr(linededup, "MANY", many)
    rng, rows = random.Random(8), []
    pool = own_words(rng, 150)
    period = own_words(rng, 4) * 30
    for i in range(60):
        x = []
        for _ in range(rng.randint(1, 3)):
            at, n = rng.randrange(100), rng.randint(5, 60)
            x += own_words(rng, rng.randint(0, 12)) + pool[at : at + n]
        rows.append((i, " ".join(x + period[: rng.choice([0, 0, 0, 90, 113])])))
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows).repartition(5)).collect()}
    want = left_by_brute_force(rows)
    assert {i: r.text.split() for i, r in got.items()} == want
    assert sum(r.removed_words > 0 for r in got.values()) > 20


def test_ranges_that_meet_are_one(spark):
    """By text, earlier place and shift; a null id is one like others."""
    schema = "id long, key long, lines boolean, fid long, fkey long, shift int, lo int, hi int"
    rows = [(1, 5, False, 0, 5, 3, 0, 30), (1, 5, False, 0, 5, 3, 31, 50), (1, 5, True, 0, 5, 3, 30, 31),
            (1, 5, True, 0, 5, 3, 60, 64), (1, 5, False, 0, 5, 4, 40, 70), (1, 6, False, 0, 5, 3, 50, 80),
            (None, 5, True, None, 5, 9, 10, 14), (None, 5, False, None, 5, 9, 12, 50), (2, 5, False, 0, 5, 3, 2, 90), (2, 5, False, 0, 5, 3, 5, 40)]
    got = linededup._merged(spark.createDataFrame(rows, schema).repartition(3), "bigint").collect()
    assert sorted(((r.id is None, r.id or 0, r.key, r.shift, r.lo, r.hi, r.lines) for r in got)) == [
        (False, 1, 5, 3, 0, 50, False), (False, 1, 5, 3, 60, 64, True), (False, 1, 5, 4, 40, 70, False), (False, 1, 6, 3, 50, 80, False),
        (False, 2, 5, 3, 2, 90, False), (True, 0, 5, 9, 10, 14, True), (True, 0, 5, 9, 12, 50, False)]
