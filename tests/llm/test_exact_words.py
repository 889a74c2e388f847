"""Words that a polynomial hash modulo 2**64 takes for one, whatever its base."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from surgecast.llm import decontam, lattice, linededup, minhash, pretok, tokenfile, tokens, words as W

from .common import frame

A = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))  # the Thue-Morse word
B = A.translate(str.maketrans("ab", "ba"))
ROWS = [(0, A), (1, B), (2, " ".join(f"{A}{i}" for i in range(31))), (3, " ".join(f"{B}{i}" for i in range(31)))]


def test_hashes_and_groups():
    w = W.scan([A.encode(), B.encode(), A.upper().encode()])
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
    for pattern in ("gpt", "word"):
        got = pretok.split([t for _, t in ROWS], pattern)
        assert {A, B} <= {x.strip() for x in got.words}
        again = "".join(got.words[i] for i in got.which[got.first[2] : got.first[3]])
        assert again == (ROWS[2][1] if pattern == "gpt" else ROWS[2][1].replace(" ", ""))


def test_groups_are_compared(monkeypatch):
    """Also where every hash collides, and when only some do."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    edge = np.unique(np.concatenate(([0, 4000], rng.integers(0, 4000, 1500))))
    start, end = edge[:-1], edge[1:]
    raw = data.tobytes()
    text = [raw[a:b] for a, b in zip(start, end)]
    for hash_ in (np.zeros(len(start), np.uint64), np.array([len(t) for t in text], np.uint64), W.hashes(data, start, end)):
        which, place = W.distinct(data, start, end, hash_)
        assert [text[place[k]] for k in which] == text and len(place) == len(set(text))
        assert all(text.index(text[p]) == p for p in place)
    other = np.frombuffer(raw[::-1], np.uint8)
    same = W.equal(data, start, end, other, start, end)
    assert same.tolist() == [raw[a:b] == raw[::-1][a:b] for a, b in zip(start, end)]
    assert W.equal(data, start, end, data, start, end).all()


def test_encoding_and_counts(spark):
    ranks = tokens.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    df = frame(spark, ROWS)
    for r in tokens.decode(tokens.encode(df, ranks), ranks).collect():
        assert hashlib.sha256(r.bytes).hexdigest() == hashlib.sha256(dict(ROWS)[r.doc_id].encode()).hexdigest()
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in tokens.count_tokens(df, path).collect():
        assert r.n_tokens == len(library.encode(dict(ROWS)[r.doc_id], add_special_tokens=False).ids)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    path = tokenfile.write(tokenfile.encoded(frame(spark, ROWS), spec, end_id=1), str(tmp_path / "t"), vocabulary=49_408)
    for r in tokenfile.read(spark, path).collect():
        want = library.encode(dict(ROWS)[r.doc_id], add_special_tokens=False).ids + [1]
        assert np.frombuffer(r.ids, np.uint32).tolist() == want


def test_no_text_is_lost_and_nothing_linked(spark):
    df = frame(spark, ROWS)
    assert {r.doc_id: r.text for r in linededup.dedup(df).collect()} == dict(ROWS)
    groups = minhash.near_duplicates(df).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in groups)


def test_unequal_words_are_no_leak(spark):
    items = spark.createDataFrame([(9, ROWS[2][1])], "item_id long, text string")
    found = {r.doc_id: len(r.leaks) for r in decontam.find(frame(spark, ROWS), items).collect()}
    assert found == {0: 0, 1: 0, 2: 1, 3: 0}


def test_scores_know_the_words_apart(spark):
    pieces, weight = lattice.read_pieces(P.path("piece_bpe_32k.model"))
    rows = [(0, A), (1, A), (3, f"{A} {B}"), (4, B)]
    got = {r.doc_id: r for r in lattice.score_documents(frame(spark, rows), pieces, weight, rounds=1).collect()}
    held = {i: got[i].held_out for i, _ in rows}
    counts = {w: sum(t.split().count(w) for i, t in rows if not held[i]) for w in (A, B)}
    for i, t in rows:
        assert got[i].n_known - 1 == sum(counts[w] > 0 for w in t.split())


def test_lattices_are_told_apart_by_content():
    one = [bytes([i]) for i in range(97, 123)]
    other = [*one, b"ab"]
    assert lattice.cached(one).n == 26 and lattice.cached(other).n == 27 and lattice.cached(list(one)).n == 26
    assert lattice.cached(one) is lattice.cached(list(one))
