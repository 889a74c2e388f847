"""Line dedup by content-defined chunks of lines, and the bytes compared before a removal."""

import random

import numpy as np
import pytest

from surgecast.llm import linededup, words as W

from .common import frame
from .test_dedup import own_words


def lines_of(text):
    return [tuple(w) for x in text.split("\n") if (w := x.split())]


def chunks_of(text):
    """(first line, line behind) of the chunks of a text, by its lines alone."""
    lines = lines_of(text)
    w = W.scan([text.encode()], fold=False)
    c = linededup.Chunks(w)
    before = np.cumsum([0, *map(len, lines)]).tolist()
    return [(before.index(a), before.index(a + n)) for a, n in zip(c.first.tolist(), c.size.tolist())]


def left_by_brute_force(rows, least=30):
    """Words left of each text: chunks at an earlier place go, with equal lines on either
    side, and windows at an earlier place."""
    chunk, window, left = {}, {}, {}
    texts = {i: lines_of(t) for i, t in rows}
    for i, t in sorted(rows):
        lines = texts[i]
        before = np.cumsum([0, *map(len, lines)]).tolist()
        w, gone = [x for line in lines for x in line], set()
        for a, b in chunks_of(t):
            j, c = chunk.setdefault(tuple(lines[a:b]), (i, a))
            if (j, c) == (i, a):
                continue
            other = texts[j]
            while a > 0 and c > 0 and lines[a - 1] == other[c - 1]:
                a, c = a - 1, c - 1
            while b < len(lines) and c + b - a < len(other) and lines[b] == other[c + b - a]:
                b += 1
            gone.update(range(before[a], before[b]))
        for k in range(len(w) - least + 1):
            x = tuple(w[k : k + least])
            if window.setdefault(x, (i, k)) != (i, k):
                j, c = window[x]
                gone.update(range(max(k, c + least) if j == i else k, k + least))
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    return left


def test_short_blocks_of_lines_go(spark):
    """Blocks of lines of fewer words than a stretch, between different neighbours."""
    rng, rows, blocks = random.Random(12), [], []
    for _ in range(12):
        block = [" ".join(own_words(rng, 2)) for _ in range(12)]
        for _ in range(3):
            a, b = ([" ".join(own_words(rng, rng.randint(1, 9))) for _ in range(5)] for _ in range(2))
            blocks.append(block)
            rows.append((len(rows), "\n".join([*a, *block, *b])))
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows, ["lines", "from", "to", "fid", "piece"])).collect()}
    for i, t in rows:
        assert got[i].removed_words == (24 if i % 3 else 0)
        assert lines_of(got[i].text) == [x for x in lines_of(t) if not (i % 3 and " ".join(x) in blocks[i])]


@pytest.mark.parametrize("seed", range(3))
def test_lines_as_brute_force(spark, seed):
    """Runs of common lines cut anywhere, some wrapped anew, some texts of common lines
    alone; blank lines between."""
    rng, rows = random.Random(seed), []
    pool = [" ".join(own_words(rng, rng.choice([1, 1, 2, 3, 6, 15]))) for _ in range(60)]
    for i in range(120):
        x = []
        for _ in range(rng.randint(1, 4)):
            x += [" ".join(own_words(rng, rng.randint(1, 12))) for _ in range(rng.choice([0, 1, 4]))]
            at = rng.randrange(55)
            x += pool[at : at + rng.randint(1, 15)] + [""] * (i % 2)
        glue = rng.choice(["\n", "\n", " \r\n", " "])
        rows.append((i, glue.join(x)))
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows).repartition(5)).collect()}
    want = left_by_brute_force(rows)
    assert {i: r.text.split() for i, r in got.items()} == want
    short = [i for i, t in rows if 0 < got[i].removed_words < 30]
    assert short and all(got[i].removed_words == len(t.split()) - len(want[i]) for i, t in rows)


def test_chunk_ends_depend_on_the_lines_nearby():
    rng = random.Random(2)
    block = [" ".join(own_words(rng, 3)) for _ in range(60)]
    cuts = []
    for _ in range(20):
        a, b = ([" ".join(own_words(rng, 4)) for _ in range(rng.randint(0, 9))] for _ in range(2))
        chunks = chunks_of("\n".join([*a, *block, *b]))
        assert all(e - s >= 2 for s, e in chunks)
        cuts.append([(s - len(a), e - len(a)) for s, e in chunks if s - len(a) >= 8 and e - len(a) <= 55])
    assert cuts[0] and all(c == cuts[0] for c in cuts)


def test_texts_of_one_hash_keep_what_differs(spark):
    """1,024 words in the Thue-Morse order of two, and the same with the two changed over: sums
    of powers modulo 2**64 take them for one."""
    rng = random.Random(0)  # words that shared a name as well when windows were hashed so
    order = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = own_words(rng, 2)
    one, other = (" ".join((x, y)[k] for k in order) for x, y in ((a, b), (b, a)))
    rows = [(0, one), (1, other), (2, other)]
    got = {r.doc_id: (r.text, r.removed_words) for r in linededup.dedup(frame(spark, rows), least=1024).collect()}
    assert got == {0: (one, 0), 1: (other, 0), 2: ("", 1024)}


def spans(text, lo, hi, piece, lines=False, at=0):
    raw = text.encode()
    w = W.scan([raw], fold=False)
    return linededup.without(text, raw, w.start, w.end, [{"lo": lo, "hi": hi, "lines": lines, "at": at, "piece": piece}], 3)


def test_bytes_decide_what_goes():
    """Whatever the hashes say: the words and lines at the earlier place are compared."""
    text = "own a b\n c d e more"
    assert spans(text, 1, 6, b" a b c\td e ") == ("own more", 5)
    assert spans(text, 1, 6, b"a b C d e") == (text, 0)
    assert spans(text, 1, 6, b"a X c d e") == ("own a b more", 3)
    assert spans(text, 1, 6, b"v w x y z") == (text, 0)
    text = "own\na b\nc\nd\nmore"
    assert spans(text, 1, 4, b"x\na b\nc\nd\ny", True, 1) == ("own\nmore", 4)
    assert spans(text, 1, 4, b"x\na b c\nd\ny", True, 1) == (text, 0)
    assert spans(text, 1, 4, b"x\na b\nC\nd\ny", True, 1) == (text, 0)
    assert spans(text, 1, 4, b"\nown\na b\nc\nd\nmo", True, 1) == ("\nmore", 5)


def test_pipeline_stage_takes_chunks_out(spark):
    """A text that is a repeated chunk goes, one with more keeps the rest; one that differs in a byte stays."""
    import corpus_pipeline as cp

    rng = random.Random(15)
    block = "\n".join(" ".join(own_words(rng, 3)) for _ in range(6))
    other = block[:-1] + block[-1].upper()
    rows = [(0, block), (1, block), (2, block + "\nmore"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, docs, "").collect()}
    assert got[0] == (block, len(block)) and 1 not in got and got[3] == (None, 0)
    assert got[2][0].split() == ["more"] and got[2][1] == len(got[2][0])
    assert spans(other, 0, 18, f"\n{block}\n".encode(), True, 0)[0].split() == other.split()[15:]
    assert spans(other.lower().upper(), 0, 18, f"\n{block}\n".encode(), True, 0) == (other.upper(), 0)
