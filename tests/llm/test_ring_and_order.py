import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from surgecast.llm import ordermin, ring

from .common import awkward, frame, sentence


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_counts_slots_and_sizes(spark, shards):
    rows = awkward() + [(500 + i, "the hot text") for i in range(90)]
    got = ring.shard(frame(spark, rows, ["shard", "size", "_at"]), shards).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    again = ring.shard(frame(spark, rows[::-1]), shards).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in got)


def test_ring_is_the_greedy_walk():
    """The pieces against a walk of one key after another."""
    rng = np.random.default_rng(3)
    place, owner = ring.ring_points(5, 4)
    rows = rng.integers(0, 30, len(place) + 1)
    rows[3] = 200
    total = int(rows.sum())
    capacity = [total // 5 + (s < total % 5) for s in range(5)]
    to = np.zeros(total, int)
    cut = ring.pieces(rows, owner, capacity)
    edges = [c[0] for c in cut] + [total]
    for (a, s, _), b in zip(cut, edges[1:]):
        to[a:b] = s
    room, left = list(capacity), [(arc, k) for arc, n in enumerate(rows) for k in range(n)]
    want, begin = {}, np.cumsum(rows) - rows
    for hop in range(len(owner)):
        rest = []
        for arc, k in left:
            s = int(owner[(arc + hop) % len(owner)])
            if room[s]:
                room[s] -= 1
                want[int(begin[arc]) + k] = s
            else:
                rest.append((arc, k))
        left = rest
    assert [want[i] for i in range(total)] == to.tolist()


def test_equal_texts_stand_together_and_little_moves(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 8) for _ in range(300)]
    rows = [(i, texts[i // 3]) for i in range(900)]
    at = {r.doc_id: r.shard for r in ring.shard(frame(spark, rows), 6, slack=0.3).collect()}
    apart = sum(len({at[3 * k + j] for j in range(3)}) > 1 for k in range(300))
    assert apart <= 8
    more = {r.doc_id: r.shard for r in ring.shard(frame(spark, rows), 7, slack=0.3).collect()}
    assert sum(at[i] != more[i] for i in at) < 450  # a plain remainder would move six of seven


def test_empty_ring(spark):
    assert ring.shard(frame(spark, [(1, "a")]).limit(0)).count() == 0


def plain_fingerprint(text):
    """Order MinHash worked out one coordinate after another, without thresholds."""
    old = ordermin._PIECE
    n = len(text) - ordermin.WIDTH + 1
    pts = ordermin.code_points(text)
    full = ordermin.fingerprint(pts)
    ordermin._PIECE = 7
    try:
        assert (ordermin.fingerprint(pts) == full).all()
    finally:
        ordermin._PIECE = old
    return full, n


def test_fingerprint_does_not_hang_on_pieces_and_guesses(monkeypatch):
    rng = random.Random(4)
    for text in ("", "a", "abcdefgh", "abcdefghi", "a" * 40, "ab" * 3000, sentence(rng, 3000)):
        full, n = plain_fingerprint(text)
        assert full.shape == (ordermin.COORDINATES,) and (n < 1 and text == "") == (not full.any())
    text = sentence(rng, 400)
    a, b = ordermin.fingerprint(ordermin.code_points(text)), ordermin.fingerprint(ordermin.code_points(text[:-30] + sentence(rng, 5)))
    other = ordermin.fingerprint(ordermin.code_points(sentence(rng, 400)))
    assert ordermin.likeness(a, a) == 1 and ordermin.likeness(a, b) > 0.5 > 0.2 > ordermin.likeness(a, other)
    # sensitive to order: the same parts in another order are less alike than an edit
    w = text.split()
    swapped = " ".join(w[200:] + w[:200])
    assert ordermin.likeness(a, ordermin.fingerprint(ordermin.code_points(swapped))) < ordermin.likeness(a, b)


def test_next_document_and_edit(spark):
    rows = [(i, t) for i, t in awkward() if i not in (7, 8, None)]
    got = {r.doc_id: r for r in ordermin.fingerprints(frame(spark, rows, ["part", "edge", "sign"])).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        sign, other, near = (ordermin.fingerprint(ordermin.code_points(x)) for x in (t, changed, after))
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == sign.tobytes().hex() and got[i].edited_fingerprint == other.tobytes().hex()
        assert got[i].near_edited == (sign == other).mean() and got[i].near_next == (sign == near).mean()


def test_few_rows_and_odd_ids(spark):
    one = ordermin.fingerprints(frame(spark, [(5, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert ordermin.fingerprints(frame(spark, [(1, "a")]).limit(0)).count() == 0
    rows = ordermin.fingerprints(frame(spark, [(None, "x" * 30), (1, "y" * 30), (1, "y" * 30), (2, None)])).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {None, 1, 2}
