"""Scoring texts by a subword lattice.

A word is generated by any run of vocabulary pieces that spells it; its
probability is the sum over all segmentations (forward recursion in log space).
The vocabulary and its first weights are those of an existing tokenizer; the
weights are then fitted to the training documents' distinct words by expectation
maximisation over their global table.  A word of the training documents is an arc
of its own over the whole lattice: ``DISCOUNT`` is taken from each such count, and
what that sets free weights the runs of pieces.  An end closes a text.  So the
probabilities of all texts add up to at most one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks, words as W
from .common import keep, partitions, released

ROUNDS = 4  # of expectation maximisation
DISCOUNT = 0.75  # of a training word's count, left to the pieces
PRIOR = 0.1  # added to the expected count of every piece
CELLS = 1 << 20  # word bytes worked on at once
_START = b" "  # stands before a word, as the mark of word starts does in the vocabulary


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and first weights (log) of a SentencePiece model.

    Pieces that no lower-cased word can hold are left out; every byte is a piece.
    Scores of a merge vocabulary are negative ranks, so the first weight of a
    piece is that of a Zipf law at its rank; bytes have the lowest rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if not raw or b" " in raw[1:] or any(65 <= b <= 90 for b in raw):
            continue
        rank[raw] = max(0.0, -model.get_score(i))
    low = max(rank.values(), default=0.0) + 1
    for b in range(256):
        if not 65 <= b <= 90:
            rank.setdefault(bytes([b]), low)
    pieces = sorted(rank)
    weight = -np.log(np.array([rank[p] for p in pieces]) + 10.0)
    return pieces, weight - np.log(np.exp(weight).sum())


class Lattice:
    """Look-ups and recursions for a fixed list of pieces, for many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(len(p) for p in pieces)
        self.n = len(pieces)
        value = np.array([self._hash(p) for p in pieces], np.uint64)
        if len(np.unique(value)) != len(value):
            raise ValueError("two pieces have one hash")
        # each piece stands in one of two places, so a look-up reads two
        self.keys = np.zeros((2, 1 << 16), np.uint64)
        self.ids = np.full((2, 1 << 16), -1, np.int64)
        for i in range(len(pieces)):
            held, side = i, 0
            for _ in range(1000):
                slot = int(value[held] >> np.uint64(48 if side == 0 else 32)) & 0xFFFF
                old = int(self.ids[side, slot])
                self.ids[side, slot], self.keys[side, slot] = held, value[held]
                if old < 0:
                    break
                held, side = old, 1 - side
            else:
                raise ValueError("too many pieces for the table")

    @staticmethod
    def _hash(piece: bytes) -> int:
        pw, _ = W._powers(len(piece) + 1)
        return int((W._BYTE[np.frombuffer(piece, np.uint8)] * pw[: len(piece)]).sum(dtype=np.uint64))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece behind each hash; ``n`` where there is none."""
        a = (h >> np.uint64(48)).astype(np.int64)
        b = (h >> np.uint64(32)).astype(np.int64) & 0xFFFF
        hit_a = (self.keys[0, a] == h) & (self.ids[0, a] >= 0)
        hit_b = (self.keys[1, b] == h) & (self.ids[1, b] >= 0)
        return np.where(hit_a, self.ids[0, a], np.where(hit_b, self.ids[1, b], self.n))

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time: their places and prefix hashes."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        edge = np.flatnonzero(np.diff(size[order], prepend=-1))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(words)]):
            n = int(size[order[a]]) + 1
            step = max(1, CELLS // n)
            for c in range(a, b, step):
                at = order[c : min(b, c + step)]
                flat = np.frombuffer(b"".join(_START + words[i] for i in at), np.uint8).reshape(len(at), n)
                pw, _ = W._powers(n + 1)
                total = np.zeros((n + 1, len(at)), np.uint64)
                np.cumsum((W._BYTE[flat] * pw[:n]).T, axis=0, out=total[1:])
                yield at, total

    def _steps(self, total: np.ndarray):
        n = len(total) - 1
        _, inv = W._powers(n + 2)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                yield i, j, self._find((total[j] - total[i]) * inv[i])

    def score(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Log probability of each word, over all segmentations."""
        weight = np.append(weight, -np.inf)
        out = np.zeros(len(words))
        for at, total in self._groups(words):
            forward = np.full(total.shape, -np.inf)
            forward[0] = 0
            for i, j, piece in self._steps(total):
                w = weight[piece]
                if np.isfinite(w).any():
                    np.logaddexp(forward[j], forward[i] + w, out=forward[j])
            out[at] = forward[-1]
        return out

    def expect(self, words: list[bytes], counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` copies of the words."""
        weight = np.append(weight, -np.inf)
        out = np.zeros(self.n + 1)
        for at, total in self._groups(words):
            forward = np.full(total.shape, -np.inf)
            backward = np.full(total.shape, -np.inf)
            forward[0], backward[-1] = 0, 0
            arcs = []
            for i, j, piece in self._steps(total):
                some = np.flatnonzero(piece < self.n)
                if len(some):
                    arcs.append((i, j, some, piece[some]))
                    forward[j, some] = np.logaddexp(forward[j, some], forward[i, some] + weight[piece[some]])
            for i, j, some, piece in reversed(sorted(arcs, key=lambda x: x[0])):
                backward[i, some] = np.logaddexp(backward[i, some], backward[j, some] + weight[piece])
            for i, j, some, piece in arcs:
                share = np.exp(forward[i, some] + weight[piece] + backward[j, some] - forward[-1, some])
                out += np.bincount(piece, counts[at[some]] * share, self.n + 1)
        return out[: self.n]


def is_training(ids: list, folds: int = 7, held: int = 2) -> np.ndarray:
    """Rows to learn from, by a checksum of the id as text (a null id: of no text)."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % folds != held for i in ids], bool)


def _word_chunks(texts):
    for _, run in W.chunks(texts, 1 << 21):  # long runs share more words
        w = W.scan(run)
        raw = w.data.tobytes().lower()  # bytes.lower is A-Z alone
        which, place = W.distinct(np.frombuffer(raw, np.uint8), w.start, w.end, w.hash)
        found = [raw[a:b] for a, b in zip(w.start[place].tolist(), w.end[place].tolist())]
        yield found, which, w.first


def score_documents(docs: DataFrame, pieces: list[bytes], weight: np.ndarray, id_col: str = "doc_id",
                    text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row.

    Tokens are the lower-cased words and one end.  Words of all blocks meet by
    hash; their counts in training documents answer the base score, their table
    fits the piece weights.  Empty and null texts have the end alone.  Without a
    training document counts are 0 and the weights stay as given.
    """
    spark = docs.sparkSession
    lattice = spark.sparkContext.broadcast(pieces)
    made = blocks.build(docs, id_col, text_col, _word_chunks, partitions(spark), weigh=is_training)

    def reply(bucket, rows):
        total: dict[bytes, int] = {}
        split = [blocks.unpack_words(r["data"]) for r in rows]
        for r, found in zip(rows, split):
            for w, n in zip(found, blocks.unpack(r["weights"], np.uint32).tolist()):
                total[w] = total.get(w, 0) + n
        for r, found in zip(rows, split):
            yield {"block": r["block"], "numbers": r["numbers"], "data": blocks.pack(np.array([total[w] for w in found], np.uint64)),
                   "more": r["data"]}
        used = [w for w, n in total.items() if n]
        yield {"block": -1, "numbers": None, "data": blocks.pack(np.array([total[w] for w in used], np.uint64)),
               "more": blocks.pack_words(used)}

    answers = keep(blocks.answer(made, reply, "block long, numbers binary, data binary, more binary"))
    table = answers.where("block = -1").select("data", "more")

    def sums(batches):
        for batch in batches:
            counts = [blocks.unpack(d, np.uint64) for d in batch.column(0).to_pylist()]
            yield pa.record_batch({"v": pa.array([len(c) for c in counts], pa.int64()), "n": pa.array([int(c.sum()) for c in counts], pa.int64())})

    seen = table.mapInArrow(released(sums), "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    train_docs = made.where("bucket < 0").select("ids").mapInArrow(released(_train_docs), "n long").agg(F.sum("n")).first()[0] or 0
    train_tokens = (seen["n"] or 0) + train_docs
    distinct = (seen["v"] or 0) + (train_docs > 0)

    for _ in range(rounds if train_docs else 0):
        now = spark.sparkContext.broadcast(weight)

        def expected(batches):
            own, out = cached(lattice.value), np.zeros(len(lattice.value))
            for batch in batches:
                for m in batch.column(1).to_pylist():
                    found = blocks.unpack_words(m)
                    out += own.expect(found, np.ones(len(found)), now.value)
            used = np.flatnonzero(out)
            yield pa.record_batch({"piece": pa.array(used.astype(np.int32)), "n": pa.array(out[used])})

        uses = np.full(len(pieces), PRIOR)  # as many rows as pieces at most
        for r in table.mapInArrow(released(expected), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            uses[r["piece"]] += r["n"]
        weight = np.log(uses) - np.log(uses.sum())
    final = spark.sparkContext.broadcast(weight)
    types = seen["v"] or 0
    free = DISCOUNT * types / train_tokens if train_tokens else 1.0  # what the discounts leave to the pieces
    log_free = float(np.log(free)) if free else -np.inf
    log_end = float(np.log10(train_docs / train_tokens)) if train_docs else 0.0
    unit = float(np.log10(train_tokens + distinct + 1))
    end_gain = float(np.log10(train_docs + 1))

    def assemble(head, rows):
        number = np.concatenate([blocks.unpack_rising(r["numbers"]) for r in rows]) if rows else np.zeros(0, np.uint32)
        known = np.zeros(len(number), np.int64)
        points = np.zeros(len(number))
        if rows:
            known[number] = np.concatenate([blocks.unpack(r["data"], np.uint64) for r in rows]).astype(np.int64)
            by_pieces = cached(lattice.value).score([w for r in rows for w in blocks.unpack_words(r["more"])], final.value) + log_free
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(known[number] - DISCOUNT, 0) / max(train_tokens, 1))
            points[number] = np.logaddexp(by_pieces, whole) / np.log(10)
        stream, lengths = blocks.unpack_stream(head["data"]), blocks.unpack(head["numbers"], np.uint32).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(lengths)))
        gain = np.log10(known + 1.0)
        add = lambda x: _sums(x[stream], edge)
        n = lengths + 1
        held = ~is_training(head["ids"])
        yield pa.record_batch({
            id_col: pa.array(head["ids"], id_type), "held_out": pa.array(held), "n_tokens": pa.array(n),
            "n_known": pa.array(add((known > 0).astype(np.int64)) + (train_docs > 0)),
            "train_tokens": pa.array(np.full(len(n), train_tokens, np.int64)),
            "base_score": pa.array(add(gain) + end_gain - n * unit), "score": pa.array(add(points) + log_end)})

    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.gather(made, answers.where("block >= 0"), assemble, schema)


_held: list[tuple[list[bytes], Lattice]] = []


def cached(pieces: list[bytes]) -> Lattice:
    """The lattice of a broadcast vocabulary, built once in a worker; the vocabulary is
    held with it, and compared."""
    if not _held or (_held[0][0] is not pieces and _held[0][0] != pieces):
        _held[:] = [(pieces, Lattice(pieces))]
    return _held[0][1]


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of ``x[edge[i]:edge[i + 1]]``; 0 for empty runs."""
    out = np.zeros(len(edge) - 1, x.dtype)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        out[some] = np.add.reduceat(x, edge[some])
    return out


def _train_docs(batches):
    for batch in batches:
        yield pa.record_batch({"n": pa.array([int(is_training(ids).sum()) for ids in batch.column(0).to_pylist()], pa.int64())})
