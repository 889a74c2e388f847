"""Token-id files: encode, pack by range asymmetric numeral system, read back.

Layout under ``path``: ``frequencies`` (the shared table: id, frequency) and
``blocks`` (rows in document order: part, seq, start, ids of the documents, token
counts, packed ids; see ``rans``).  Both are written through Spark's committer,
so a lost executor leaves no half file.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blocks, pretok, rans, tokens
from .common import keep, partitions, prepare, released

JOINED = 100  # words handed to the library in one string
ROW_IDS = 1 << 20  # ids in a row of blocks, about; a longer document makes a longer row


_encoders: dict[str, object] = {}


def worker_encoder(spec: str):
    """The encoder of a worker process: its tables and words serve one task after another."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = word_encoder(spec)
    return _encoders[spec]


def word_encoder(spec: str):
    """``encode(texts) -> (ids, ids per text)`` equal to the library's on a
    lower-casing word tokenizer: pre-tokens are cut for many texts at once, and
    the library encodes each distinct one of a task once.  Texts that hold a
    special string go to the library whole."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library, model, nfc = Tokenizer.from_str(spec), Tokenizer.from_str(spec), normalizers.NFC()
    model.normalizer = normalizers.Sequence([])
    model.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    described = json.loads(spec)
    special = [t["content"] for t in described["added_tokens"]]
    mark, vocabulary = described["model"]["end_of_word_suffix"], described["model"]["vocab"]
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
    number: dict[str, int] = {}  # of a word; its ids are flat[begin[n]:begin[n] + size[n]]
    flat, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def composed(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = nfc.normalize_str(text)
            if "\u0130" in text:
                text = text.replace("\u0130", "i\u0307")
        return text

    def learn(words: list[str]) -> None:
        nonlocal flat, size
        joined = ["\n".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)]
        found = model.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        stop = np.flatnonzero(last[ids]) + 1  # every word ends in the one token that carries the end mark
        if len(stop) != len(words):
            raise ValueError("a word was not encoded to one run of tokens")
        flat, size = np.concatenate((flat, ids)), np.concatenate((size, np.diff(stop, prepend=0)))
        number.update(zip(words, range(len(number), len(number) + len(words))))

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal flat, size
        odd = {i for i, t in enumerate(texts) if any(m in t for m in special)}
        s = pretok.split(["" if i in odd else composed(t) for i, t in enumerate(texts)], "word", pretok.library_classes())
        if len(number) > tokens.MEMO_WORDS:
            number.clear()
            flat, size = flat[:0], size[:0]
        known = np.array(list(map(number.get, s.words, repeat(-1))), np.int64)
        if len(fresh := np.flatnonzero(known < 0)):
            known[fresh] = np.arange(len(number), len(number) + len(fresh))
            learn([s.words[i] for i in fresh])
        begin = np.cumsum(size) - size
        which = known[s.which] if len(known) else np.zeros(0, np.int64)
        ids, per = tokens.take(flat, begin[which], size[which])
        lengths = np.diff(np.concatenate(([0], np.cumsum(per)))[s.first])
        if odd:
            edge = np.concatenate(([0], np.cumsum(lengths)))
            each = [library.encode(t, add_special_tokens=False).ids if i in odd else ids[edge[i] : edge[i + 1]]
                    for i, t in enumerate(texts)]
            lengths = np.array([len(x) for x in each], np.int64)
            ids = np.concatenate([np.asarray(x, np.uint32) for x in each])
        return ids, lengths

    return encode


def encoded(docs: DataFrame, spec: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in ascending id order as rows ``(part, seq, start, ids, lengths,
    n_ids, data)``, start within the part; checkpointed, so order and places hold
    for all that reads them.  Null ids come first; rows of one id are ordered by
    their text; a null text is empty (its end id alone)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(spec)

    def run(batches):
        encode = worker_encoder(table.value)
        part, seq, start, ids, lengths, held, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def flush():
            nonlocal seq, start, ids, lengths, held, size
            out = pa.record_batch({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "start": pa.array([start], pa.int64()),
                "ids": pa.array([ids], pa.list_(id_type)), "lengths": pa.array([blocks.pack(np.concatenate(lengths))], pa.binary()),
                "n_ids": pa.array([size], pa.int64()), "data": pa.array([blocks.pack(np.concatenate(held))], pa.binary())})
            seq, start, ids, lengths, held, size = seq + 1, start + size, [], [], [], 0
            return out

        for batch in batches:
            id_type, names, done = batch.column(0).type, batch.column(0).to_pylist(), 0
            for texts in pretok.runs(batch.column(1).to_pylist()):
                flat, n = encode(texts)
                whole = np.insert(flat, np.cumsum(n), np.uint32(end_id)).astype(np.uint32)
                ids.extend(names[done : done + len(texts)])
                done += len(texts)
                lengths.append((n + 1).astype(np.uint32))
                held.append(whole)
                size += len(whole)
                if size >= ROW_IDS:
                    yield flush()
        if size:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    tie = F.xxhash64(F.col(text_col)).alias("_tie")
    ordered = (docs.select(id_col, text_col, tie).repartitionByRange(partitions(spark), id_col, "_tie")
               .sortWithinPartitions(id_col, "_tie").select(id_col, text_col))
    return keep(ordered.mapInArrow(released(run), f"part int, seq long, start long, ids array<{kind}>, lengths binary, n_ids long, data binary"))


def write(rows: DataFrame, path: str, vocabulary: int) -> str:
    """Count the ids of all rows, then pack and write them under ``path``."""
    spark = rows.sparkSession

    def histogram(batches):
        count = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                count += np.bincount(blocks.unpack(data, np.uint32), minlength=vocabulary)
        used = np.flatnonzero(count)
        yield pa.record_batch({"id": pa.array(used.astype(np.int32)), "n": pa.array(count[used])})

    counted = rows.select("data").mapInArrow(released(histogram), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)  # one row per vocabulary entry at most
    for r in counted:
        counts[r["id"]] = r["n"]
    frequency = rans.normalise(counts)
    spark.createDataFrame([(int(i), int(frequency[i])) for i in np.flatnonzero(frequency)], "id int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")
    table = spark.sparkContext.broadcast(frequency)
    before, at = {}, 0  # one entry per part
    for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r["part"]], at = at, at + r["n"]

    def run(batches):
        coder = rans.Coder(table.value)
        for batch in batches:
            columns = batch.to_pydict()
            out = [coder.pack(blocks.unpack(d, np.uint32)) for d in columns["data"]]
            start = [before[p] + s for p, s in zip(columns["part"], columns["start"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("seq"), pa.array(start, pa.int64()), batch.column("ids"), batch.column("lengths"),
                 batch.column("n_ids"), pa.array(out, pa.binary())], batch.schema.names)

    rows.mapInArrow(released(run), rows.schema).write.parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document of the files at ``path``;
    ids are packed little-endian unsigned 32-bit.  A wrong checksum is an error."""
    prepare(spark)
    listed = spark.read.parquet(f"{path}/frequencies").collect()  # bounded by the vocabulary
    frequency = np.zeros(max((r["id"] for r in listed), default=0) + 1, np.int64)
    for r in listed:
        frequency[r["id"]] = r["frequency"]
    table = spark.sparkContext.broadcast(frequency)
    rows = spark.read.parquet(f"{path}/blocks")

    def run(batches):
        coder = rans.Coder(table.value)
        for batch in batches:
            for start, names, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("start", "ids", "lengths", "data"))):
                raw = coder.unpack(data).astype("<u4").tobytes()
                n = blocks.unpack(lengths, np.uint32).astype(np.int64)
                place = np.concatenate(([0], np.cumsum(n)))
                yield pa.record_batch({
                    id_col: pa.array(names, batch.schema.field("ids").type.value_type), "start": pa.array(start + place[:-1]), "n_tokens": pa.array(n),
                    "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(place[:-1].tolist(), place[1:].tolist())], pa.binary())})

    kind = rows.schema["ids"].dataType.elementType.simpleString()
    return rows.select("start", "ids", "lengths", "data").mapInArrow(released(run), f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
