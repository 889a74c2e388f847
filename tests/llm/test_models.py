import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from surgecast.llm import decontam, lattice, toxic

from .common import awkward, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ toxicity

def labelled(n=600, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad = i % 6 == 0
        w = sentence(rng, rng.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "mor0n", "l.o.s.e.r", "zorgon"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxic.score(frame(spark, rows, ["score", "words", "lang"]), lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_labels_and_ids_are_no_input(spark):
    """Other labels on held-out rows, and other ids for the same text, change no score."""
    rows, labels = labelled(300)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a = {r.doc_id: r.score for r in toxic.score(frame(spark, rows), lab).collect()}
    b = {r.doc_id: r.score for r in toxic.score(frame(spark, rows), spark.createDataFrame(turned, "doc_id long, toxic int")).collect()}
    assert a == b
    extra = rows + [(10_000, rows[0][1]), (10_001, None), (10_002, ""), (None, rows[0][1])]
    c = toxic.score(frame(spark, extra), lab).collect()
    assert len(c) == len(extra)
    same = {round(r.score, 12) for r in c if r.doc_id in (0, 10_000, None)}
    assert len(same) == 1 and len({r.score for r in c if r.doc_id in (10_001, 10_002)}) == 1


def test_without_classes_or_rows(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxic.score(docs, none).collect()] == [0.0, 0.0]
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxic.score(docs, odd).collect()} <= {0.0, 1.0}
    assert toxic.score(docs.limit(0), none).count() == 0


# ------------------------------------------------------------------ lattice

PIECES = lattice.read_pieces(P.path("piece_bpe_32k.model"))


def test_lattice_sums_all_segmentations():
    pieces, weight = PIECES
    own = lattice.Lattice(pieces)
    number = {p: i for i, p in enumerate(pieces)}

    def brute(word):
        text, total = b" " + word, [1.0] + [0.0] * (len(word) + 1)
        for j in range(1, len(text) + 1):
            total[j] = sum(total[i] * math.exp(weight[number[text[i:j]]]) for i in range(j) if text[i:j] in number)
        return math.log(total[-1])

    words = [b"the", b"thereof", b"a", "straße".encode(), b"x" * 30, b"internationalisation", bytes([200, 201])]
    assert own.score(words, weight) == pytest.approx([brute(w) for w in words])
    long = own.score([b"ab" * 3000], weight)
    assert np.isfinite(long).all()
    # the expected pieces spell as many bytes as the words have
    uses = own.expect(words, np.ones(len(words)), weight)
    assert sum(u * len(p) for u, p in zip(uses, pieces)) == pytest.approx(sum(len(w) + 1 for w in words))


def test_scores_of_documents(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6))
                 for r in lattice.score_documents(frame(spark, rows, ["block", "score"]), *PIECES, rounds=1).collect())
    split = [(i, WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows]
    train = [i for i, _ in split if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for i, ws in split if i in set(train) for w in ws)
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in split)
    total, distinct = sum(seen.values()) + ends, len(seen) + 1
    want = []
    for i, ws in split:
        counts = [seen[w] for w in ws] + [ends]
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in counts)
        want.append((i, len(counts), sum(c > 0 for c in counts), total, i not in set(train), round(base, 6)))
    assert got == sorted(want)


def test_fitted_score_is_a_probability_and_learns(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 30)) for i in range(120)] + [(500, "qzx " * 30)]
    got = {r.doc_id: r for r in lattice.score_documents(frame(spark, rows), *PIECES, rounds=2).collect()}
    assert all(r.score < 0 for r in got.values())
    per = lambda i: got[i].score / got[i].n_tokens
    held = [i for i in got if got[i].held_out and i != 500]
    assert held and min(map(per, held)) > per(500) - 3
    raw = {r.doc_id: r.score for r in lattice.score_documents(frame(spark, rows), *PIECES, rounds=0).collect()}
    assert sum(got[i].score for i in held) > sum(raw[i] for i in held)


def test_no_training_document(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lattice.score_documents(frame(spark, [(held, "some words")]), *PIECES).first()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0
    assert lattice.score_documents(frame(spark, [(1, "a")]).limit(0), *PIECES).count() == 0


# ------------------------------------------------------------- decontamination

def planted(seed=3):
    rng = random.Random(seed)
    items = [(k, sentence(rng, rng.randint(15, 60))) for k in range(30)] + [(40, sentence(rng, 4)), (41, None), (42, "")]
    rows, truth = [], {}
    for i in range(120):
        w = sentence(rng, rng.randint(30, 200)).split()
        if i % 4 == 0:
            k = rng.randrange(30)
            p = items[k][1].split()
            for j in range(2, len(p), 6):  # every sixth word is another
                p[j] = sentence(rng, 1)
            at = rng.randrange(len(w))
            w[at:at] = p
            truth[i] = (k, at)
        rows.append((i, " ".join(w)))
    return rows, items, truth


def test_substituted_passages_are_found(spark):
    rows, items, truth = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.leaks for r in decontam.find(frame(spark, rows, ["item", "leaks"]), bench).collect()}
    for i, _ in rows:
        found = {(x.item, x.at) for x in got[i]}
        assert found == ({truth[i]} if i in truth else set()), (i, found, truth.get(i))


def test_short_items_and_slices(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two, three"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
    rows = [(1, "x ONE two three y"), (2, "one two"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon OTHER eta theta iota kappa lambda mu"),
            (6, "one\ntwo\tthree"), (7, "alpha beta gamma")]
    run = lambda: {r.doc_id: [x.item for x in r.leaks] for r in decontam.find(frame(spark, rows), bench).collect()}
    whole = run()
    assert whole == {1: [1], 2: [], 3: [], 4: [], 5: [2], 6: [1], 7: []}
    monkeypatch.setattr(decontam, "SLICE_WORDS", 4)
    assert run() == whole


def test_empty_sides(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in decontam.find(frame(spark, [(1, "a b c")]), bench).collect()] == [[]]
    assert decontam.find(frame(spark, [(1, "a")]).limit(0), bench).count() == 0
