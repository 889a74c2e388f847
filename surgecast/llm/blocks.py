"""Block dictionaries: a distinct-word shuffle that carries words, not occurrences.

A block is a run of documents of one task.  It holds the text as a stream of
word numbers (positions) and the distinct words behind the numbers.  Words are
dealt by a hash to buckets, where all blocks' copies of a word meet and are
answered once; answers go back to their block by word number, and the block is
put together again by position.  A block is bounded by ``BLOCK_CHARS`` and
``BLOCK_WORDS`` (or one document), a bucket by the vocabulary over the number of
buckets; a word that a third of all texts use costs one entry per block.

The block table is checkpointed: numbers given by one reading are never met by
those of another.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import keep, partitions, released

BLOCK_CHARS = 32_000_000
BLOCK_WORDS = 1_000_000


def pack(data: bytes | np.ndarray) -> bytes:
    """Compressed bytes; integers by byte planes, high planes are mostly zero."""
    if isinstance(data, np.ndarray):
        data = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.dtype.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes, dtype=None):
    size = int.from_bytes(data[:8], "little")
    out = pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
    if dtype is None:
        return out
    width = np.dtype(dtype).itemsize
    return np.frombuffer(out, np.uint8).reshape(width, -1).T.copy().view(dtype).reshape(-1)


_DIRECT, _ONCE = 230, 255
_PLAIN = 2**64 - 1  # instead of the number of repeated words


def pack_stream(stream: np.ndarray, count: np.ndarray) -> bytes:
    """Word numbers (frequent words low, words met once last and in text order): a
    byte for each, two more for numbers past ``_DIRECT``.  A word met once needs its
    mark alone: the next such mark is the next such word.  With more repeated words than
    two bytes reach (one very long text) the numbers stand as they are."""
    repeated = int((count > 1).sum())
    once, far = stream >= repeated, (stream >= _DIRECT) & (stream < repeated)
    if repeated >= (_ONCE - _DIRECT) << 16:
        return _PLAIN.to_bytes(8, "little") + pack(stream.astype(np.uint32))
    first = np.where(once, _ONCE, np.where(far, _DIRECT + (stream >> 16), stream)).astype(np.uint8)
    a = pack(first)
    return repeated.to_bytes(8, "little") + len(a).to_bytes(8, "little") + a + pack(stream[far].astype(np.uint16))


def unpack_stream(data: bytes) -> np.ndarray:
    if int.from_bytes(data[:8], "little") == _PLAIN:
        return unpack(data[8:], np.uint32)
    repeated, cut = int.from_bytes(data[:8], "little"), 16 + int.from_bytes(data[8:16], "little")
    first = unpack(data[16:cut], np.uint8)
    out = first.astype(np.uint32)
    far, once = np.flatnonzero((first >= _DIRECT) & (first < _ONCE)), np.flatnonzero(first == _ONCE)
    out[far] = (out[far] - _DIRECT) << 16 | unpack(data[cut:], np.uint16)
    out[once] = repeated + np.arange(len(once))
    return out


def pack_rising(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=0).astype(np.uint32))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint32)).astype(np.uint32)


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], np.uint32)
    return len(words).to_bytes(8, "little") + len(x := pack(lengths)).to_bytes(8, "little") + x + pack(b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    cut = 16 + int.from_bytes(data[8:16], "little")
    end = np.cumsum(unpack(data[16:cut], np.uint32)).tolist()
    whole = unpack(data[cut:])
    return [whole[a:b] for a, b in zip([0, *end], end)]


Chunk = tuple[list[bytes], np.ndarray, np.ndarray]  # distinct words, which word at each place, first place of each text


def build(docs: DataFrame, id_col: str, text_col: str, chunks: Callable[[list[str | None]], Iterator[Chunk]],
          buckets: int, weigh: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """The block table ``(block, bucket, ids, numbers, data, weights)``.

    A block has one row of bucket -1 (its ids, words per document in ``numbers``,
    its stream in ``data``) and one per bucket (word numbers, words, and with
    ``weigh`` (ids -> 0/1 each) how often the word stands in documents of weight 1).
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        state = {"seq": 0}

        def fresh():
            state.update(words={}, stream=[], ids=[], lengths=[], size=0)

        def flush():
            if not state["ids"]:
                return
            lengths = np.concatenate(state["lengths"])
            stream = np.concatenate(state["stream"]) if state["stream"] else np.zeros(0, np.uint32)
            words = list(state["words"])
            count, met = np.bincount(stream, minlength=len(words)), np.empty(len(words), np.int64)
            met[stream[::-1]] = np.arange(len(stream) - 1, -1, -1)
            order = np.lexsort((met, -count))  # frequent words get low numbers, then those met earlier
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            stream, words = number[stream], [words[i] for i in order]
            weight = None
            if weigh is not None:
                own = np.repeat(np.asarray(weigh(state["ids"]), bool), lengths)
                weight = np.bincount(stream[own], minlength=len(words)).astype(np.uint32)
            block = part << 32 | state["seq"]
            state["seq"] += 1
            yield row(block, -1, state["ids"], pack(lengths.astype(np.uint32)), pack_stream(stream, count), None)
            place = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            by = np.argsort(place, kind="stable")
            edge = np.searchsorted(place[by], np.arange(buckets + 1)).tolist()
            for k in range(buckets):
                if edge[k] < edge[k + 1]:
                    own = by[edge[k] : edge[k + 1]]
                    yield row(block, k, None, pack_rising(own), pack_words([words[i] for i in own]),
                              None if weight is None else pack(weight[own]))
            fresh()

        def row(block, bucket, ids, numbers, data, weights):
            return pa.record_batch({
                "block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()),
                "ids": pa.array([ids], pa.list_(id_type)), "numbers": pa.array([numbers], pa.binary()),
                "data": pa.array([data], pa.binary()), "weights": pa.array([weights], pa.binary())})

        fresh()
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, done = batch.column(0).to_pylist(), 0
            for words, which, first in chunks(batch.column(1).to_pylist()):
                known = state["words"]
                number = np.array([known.setdefault(w, len(known)) for w in words], np.uint32)
                state["stream"].append(number[which] if len(words) else np.zeros(0, np.uint32))
                lengths = np.diff(first)
                state["ids"].extend(ids[done : done + len(lengths)])
                done += len(lengths)
                state["lengths"].append(lengths)
                state["size"] += len(which)
                if len(known) > BLOCK_WORDS or state["size"] > BLOCK_CHARS // 5:
                    yield from flush()
        yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return keep(docs.select(id_col, text_col).mapInArrow(
        released(run), f"block long, bucket int, ids array<{kind}>, numbers binary, data binary, weights binary"))


def answer(blocks: DataFrame, reply: Callable[[int, list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Deal the words of all blocks by bucket and call ``reply(bucket, rows)`` with
    all rows of a bucket at once; it yields rows of ``schema``."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != held and rows:
                    yield from out(held, rows)
                    rows = []
                held = r["bucket"]
                rows.append(r)
        if rows:
            yield from out(held, rows)

    def out(bucket, rows):
        for r in reply(bucket, rows):
            yield pa.RecordBatch.from_pylist([r], schema=target)

    target = _arrow(schema)
    assert names
    dealt = blocks.where("bucket >= 0").select("block", "bucket", "numbers", "data", "weights")
    return dealt.repartition(partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket", "block").mapInArrow(released(run), schema)


def gather(blocks: DataFrame, answers: DataFrame, assemble: Callable[[dict, list[dict]], Iterator[pa.RecordBatch]],
           schema: str) -> DataFrame:
    """Bring the answers ``(block, numbers, data, more)`` home and call
    ``assemble(stream row, answer rows)`` for each block."""

    def run(batches):
        head, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    if head is not None:
                        yield from assemble(head, rows)
                    head, rows = r, []
                else:
                    rows.append(r)
        if head is not None:
            yield from assemble(head, rows)

    streams = blocks.where("bucket < 0").select("block", F.lit(-1).alias("bucket"), "ids", "numbers", "data", F.lit(None).cast("binary").alias("more"))
    home = answers.select("block", F.lit(0).alias("bucket"), F.lit(None).cast(blocks.schema["ids"].dataType).alias("ids"),
                          "numbers", "data", "more")
    return (streams.unionByName(home).repartition(partitions(blocks.sparkSession), "block")
            .sortWithinPartitions("block", "bucket").mapInArrow(released(run), schema))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])
