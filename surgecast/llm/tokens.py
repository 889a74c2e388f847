"""Byte-level BPE: encoding by a global distinct-word shuffle, decoding by the
token-byte table, and token counts by the whole-token shortcut."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import blocks, bpe, pretok
from .common import partitions, released

MEMO_WORDS = 500_000  # words that a task remembers


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file ``base64 rank`` of a byte-level BPE."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _gpt_chunks(texts):
    for run in pretok.runs(texts):
        s = pretok.split(run)
        yield [w.encode() for w in s.words], s.which, s.first


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)``: ids are packed little-endian unsigned 32-bit.

    Pre-tokens are dealt by a hash over the whole corpus, each distinct one is
    merged once in its bucket, ids are joined back to the blocks by word number
    and put in order by position.  Null and empty texts have no ids; repeated
    rows come back repeated; other columns are not read.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    made = blocks.build(docs, id_col, text_col, _gpt_chunks, partitions(spark))

    def reply(bucket, rows):
        vocabulary = table.value
        rank, known = bpe.by_concatenation(vocabulary), {}
        for r in rows:
            out = []
            for w in blocks.unpack_words(r["data"]):
                ids = known.get(w)
                if ids is None:
                    one = vocabulary.get(w)
                    ids = known[w] = [one] if one is not None else [vocabulary[p] for p in bpe.merge(w, rank)]
                out.append(ids)
            yield {"block": r["block"], "numbers": r["numbers"],
                   "data": blocks.pack(np.array([x for ids in out for x in ids], np.uint32)),
                   "more": blocks.pack(np.array([len(ids) for ids in out], np.uint32))}

    answers = blocks.answer(made, reply, "block long, numbers binary, data binary, more binary")

    def assemble(head, rows):
        number = np.concatenate([blocks.unpack_rising(r["numbers"]) for r in rows]) if rows else np.zeros(0, np.uint32)
        flat = np.concatenate([blocks.unpack(r["data"], np.uint32) for r in rows]) if rows else number
        count = np.concatenate([blocks.unpack(r["more"], np.uint32) for r in rows]).astype(np.int64) if rows else number
        size, begin = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        size[number], begin[number] = count, np.cumsum(count) - count
        stream, lengths = blocks.unpack_stream(head["data"]), blocks.unpack(head["numbers"], np.uint32).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(lengths)))
        for a, b in slices(lengths, 500_000):
            which = stream[edge[a] : edge[b]]
            ids, per_word = take(flat, begin[which], size[which])
            per_doc = edge[a : b + 1] - edge[a]
            place = np.concatenate(([0], np.cumsum(per_word)))[per_doc]
            raw = ids.astype("<u4").tobytes()
            yield pa.record_batch({
                id_col: pa.array(head["ids"][a:b], id_type), "n_tokens": pa.array(np.diff(place), pa.int64()),
                "ids": pa.array([raw[4 * x : 4 * y] for x, y in zip(place[:-1].tolist(), place[1:].tolist())], pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return blocks.gather(made, answers, assemble, f"`{id_col}` {kind}, n_tokens long, ids binary")


def slices(lengths: np.ndarray, limit: int):
    """Runs ``(from, to)`` of documents with about ``limit`` items."""
    a, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(lengths):
        yield a, len(lengths)


def take(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[begin:begin + size]`` one after another."""
    total = int(size.sum())
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(total)] if total else flat[:0], size


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds ``bytes``, the text behind packed ids, by a map-side join with the
    token-byte table (as many rows as the vocabulary, so it is broadcast).  An
    unknown id is an error; null or no ids decode to no bytes."""
    spark = encoded.sparkSession
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    by_id = sorted((i, b) for b, i in ranks.items())
    for i, b in by_id:
        size[i] = len(b)
    table = spark.sparkContext.broadcast((np.frombuffer(b"".join(b for _, b in by_id), np.uint8), np.cumsum(size) - size, size))

    def run(batches):
        flat, begin, width = table.value
        for batch in batches:
            packed = [x or b"" for x in batch.column(ids_col).to_pylist()]
            out = []
            lengths = np.array([len(x) // 4 for x in packed], np.int64)
            for a, b in slices(lengths, 500_000):
                ids = np.frombuffer(b"".join(packed[a:b]), "<u4")
                if len(ids) and (ids.max() >= len(width) or not width[ids].all()):
                    raise ValueError("an id is not in the token-byte table")
                raw, per = take(flat, begin[ids], width[ids])
                place = np.concatenate(([0], np.cumsum(per)))[np.concatenate(([0], np.cumsum(lengths[a:b])))].tolist()
                raw = raw.tobytes()
                out.extend(raw[x:y] for x, y in zip(place[:-1], place[1:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])

    return encoded.mapInArrow(released(run), T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())]))


def read_merges(path: str) -> tuple[list[str], dict[tuple[bytes, bytes], int], list[str]]:
    """Vocabulary strings, merges by pair and special strings of a byte-level
    tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = bpe.byte_letters()

    def raw(s: str) -> bytes:
        return bytes(letters[c] for c in s)

    special = [t["content"] for t in spec["added_tokens"]]
    pairs = {}
    for i, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs[raw(a), raw(b)] = i
    strings = [raw(s) for s in spec["model"]["vocab"] if s not in special]
    return strings, pairs, special


def prove_whole(strings: list[bytes], pairs: dict[tuple[bytes, bytes], int]) -> set[str]:
    """The vocabulary strings that, as a pre-token, are merged into one token:
    each is merged from its bytes, and stays only if one part is left."""
    rank, out = bpe.by_pair(pairs), set()
    for s in strings:
        if len(bpe.merge(s, rank)) == 1:
            try:
                out.add(s.decode())
            except UnicodeDecodeError:  # part of a character: no text has it as a pre-token
                pass
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` by the whole-token shortcut.

    Pre-tokens that are proved to be one token count as one by a look-up; only the
    rest is merged (a task remembers up to ``MEMO_WORDS`` of them).  Special
    strings inside a text are one token each and part the text.  Null and empty
    texts count 0.  No shuffle; rows stay as they are.
    """
    strings, pairs, special = read_merges(path)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((prove_whole(strings, pairs), pairs, special))

    def run(batches):
        whole, merges, marks = table.value
        rank, memo = bpe.by_pair(merges), {}

        def tokens(word: str) -> int:
            if word in whole:
                return 1
            n = memo.get(word)
            if n is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                n = memo[word] = len(bpe.merge(word.encode(), rank))
            return n

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            count = np.zeros(len(texts), np.int64)
            owner, parts = [], []
            for i, t in enumerate(texts):
                pieces = [t]
                for mark in marks:
                    if mark in t:
                        pieces = [p for piece in pieces for p in piece.split(mark)]
                count[i] = len(pieces) - 1
                owner.extend([i] * len(pieces))
                parts.extend(pieces)
            done = 0
            for run_ in pretok.runs(parts):
                s = pretok.split(run_, table=pretok.library_classes())
                per = np.array([tokens(w) for w in s.words], np.int64)
                total = np.concatenate(([0], np.cumsum(per[s.which] if len(per) else [])))
                np.add.at(count, owner[done : done + len(run_)], np.diff(total[s.first]).astype(np.int64))
                done += len(run_)
            yield pa.record_batch({id_col: batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                                   "n_tokens": pa.array(count), "over_limit": pa.array(count > limit)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
