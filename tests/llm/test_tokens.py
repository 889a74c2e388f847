import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from surgecast.llm import bpe, pretok, tokens

from .common import awkward, frame

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode_as_the_library(spark, library):
    rows = awkward()
    ranks = tokens.read_ranks(RANKS)
    encoded = tokens.encode(frame(spark, rows, ["block", "bucket", "ids", "n_tokens"]), ranks)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r["bytes"])) for r in tokens.decode(encoded, ranks).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)


def test_blocks_of_any_size_agree(spark, monkeypatch):
    from surgecast.llm import blocks

    rows = awkward(3)
    ranks = tokens.read_ranks(RANKS)
    digest = lambda: sorted((str(r.doc_id), hashlib.sha256(r.ids).hexdigest()) for r in tokens.encode(frame(spark, rows), ranks).collect())
    whole = digest()
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 10)
    assert digest() == whole


def test_empty_table(spark):
    ranks = tokens.read_ranks(RANKS)
    empty = frame(spark, awkward()).limit(0)
    assert tokens.decode(tokens.encode(empty, ranks), ranks).count() == 0
    assert tokens.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_unknown_id_is_an_error(spark):
    from pyspark.errors import PySparkException

    ranks = tokens.read_ranks(RANKS)
    df = spark.createDataFrame([(1, bytearray(np.array([60_000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(PySparkException, match="token-byte table"):
        tokens.decode(df, ranks).collect()


def test_counts_as_the_library(spark):
    from tokenizers import Tokenizer

    rows = awkward() + [(50, "<|endoftext|><|endoftext|>a<|endoftext|>"), (51, "x" * 600 + " a" * 513)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame(spark, rows, ["n_tokens"]), P.path("byte_bpe_50k.json")).collect())
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((str(i), len((x or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_proved_words_are_one_token():
    strings, pairs, special = tokens.read_merges(P.path("byte_bpe_50k.json"))
    whole = tokens.prove_whole(strings, pairs)
    assert special == ["<|endoftext|>"] and " the" in whole and " tionthe" not in whole and len(whole) > 40_000


def test_long_and_short_merges_agree(monkeypatch):
    ranks = tokens.read_ranks(RANKS)
    rank = bpe.by_concatenation(ranks)
    for w in (b"aaaaaaaaaaaaaaaaaaaa", b"internationalisation" * 3, "日本語日本語日本語".encode(), b"abcabcabcabc" * 5):
        short = bpe.merge(w, rank) if len(w) <= 64 else None
        monkeypatch.setattr(bpe, "_SHORT", 0)
        long = bpe.merge(w, rank)
        monkeypatch.setattr(bpe, "_SHORT", 10_000)
        assert bpe.merge(w, rank) == long and (short is None or short == long)
        assert b"".join(long) == w
        monkeypatch.setattr(bpe, "_SHORT", 64)


def test_split_as_the_pattern():
    import random

    import regex

    rng = random.Random(4)
    letters = "ab's 'd\n\t 12!?é 'lrevtm "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for pattern, source in (("gpt", P.PATTERN), ("word", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        s = pretok.split(texts, pattern)
        for i, t in enumerate(texts):
            assert [s.words[k] for k in s.which[s.first[i] : s.first[i + 1]]] == regex.findall(source, t)


def test_stream_round_trip():
    from surgecast.llm import blocks

    rng = np.random.default_rng(1)
    for n in (0, 1, 300, 200_000):
        raw = rng.zipf(1.3, n) % 100_000
        _, raw = np.unique(raw, return_inverse=True)
        count = np.bincount(raw)
        met = np.zeros(len(count), np.int64)
        met[raw[::-1]] = np.arange(n - 1, -1, -1)
        order = np.lexsort((met, -count))
        number = np.empty(len(count), np.uint32)
        number[order] = np.arange(len(count))
        stream = number[raw] if n else np.zeros(0, np.uint32)
        assert (blocks.unpack_stream(blocks.pack_stream(stream, count)) == stream).all()
        words = [bytes([65 + i % 26]) * (i % 5) for i in range(n % 1000)]
        assert blocks.unpack_words(blocks.pack_words(words)) == words


def test_streams_of_very_many_repeated_words():
    from surgecast.llm import blocks

    n = (blocks._ONCE - blocks._DIRECT) << 16
    for repeated in (n - 1, n, n + 5):
        stream = np.concatenate((np.arange(repeated), np.arange(repeated), [repeated])).astype(np.uint32)
        assert (blocks.unpack_stream(blocks.pack_stream(stream, np.bincount(stream))) == stream).all()
