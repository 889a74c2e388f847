"""Token files: ids packed by a static range asymmetric numeral system.

All blocks of a file set share one frequency table.  A block holds ``LANES *
STEPS`` ids (the last one fewer), coded by ``LANES`` interleaved states that are
independent of other blocks.  Every ``CHECK`` steps the states and the place in
the words are kept, so that a block can be decoded from several places at once;
checksums cover the packed bytes and the ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS, CHECK = 64, 1024, 256
SCALE = 20
_LOW = np.uint64(1 << 31)
_MAGIC = b"RANS1"
_HEAD = struct.Struct("<5sBIII")  # magic, scale, ids, blocks, words


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to ``2**SCALE``; every id that occurs keeps at least 1."""
    total, whole = int(counts.sum()), 1 << SCALE
    out = np.zeros(len(counts), np.int64)
    if not total:
        out[0] = whole
        return out
    used = np.flatnonzero(counts)
    if len(used) > whole:
        raise ValueError("more distinct ids than the frequency scale can hold")
    out[used] = np.maximum(1, (counts[used].astype(object) * whole // total).astype(np.int64))
    order = used[np.lexsort((used, -out[used]))]
    rest = whole - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    for i in order:  # take what is too much from the most frequent
        if rest >= 0:
            break
        give = min(-rest, int(out[i]) - 1)
        out[i] -= give
        rest += give
    return out


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, frequency: np.ndarray):
        self.f = frequency.astype(np.uint64)
        self.c = (np.cumsum(frequency) - frequency).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)
        self.pad = int(frequency.argmax())

    def _encode(self, ids: np.ndarray):
        """``ids[block, step, lane]`` -> words by block, word counts by (block, step), kept states."""
        blocks, steps, _ = ids.shape
        x = np.full((blocks, LANES), _LOW, np.uint64)
        words, owners = [None] * steps, [None] * steps
        counts = np.zeros((blocks, steps), np.int64)
        kept = np.zeros((blocks, -(-steps // CHECK), LANES), np.uint64)
        shift, scale = np.uint64(63 - SCALE), np.uint64(SCALE)
        for s in range(steps - 1, -1, -1):
            one = ids[:, s]
            f = self.f[one]
            full = x >= (f << shift)
            words[s] = x[full].astype(np.uint32)
            counts[:, s] = full.sum(1)
            owners[s] = np.nonzero(full)[0]
            x = np.where(full, x >> np.uint64(32), x)
            d = x // f
            x = (d << scale) + (x - d * f) + self.c[one]
            if s % CHECK == 0:
                kept[:, s // CHECK] = x
        flat, owner = np.concatenate(words), np.concatenate(owners)
        return flat[np.argsort(owner, kind="stable")], counts, kept

    def pack(self, ids: np.ndarray) -> bytes:
        full = len(ids) // (LANES * STEPS)
        parts = []
        if full:
            parts.append(ids[: full * LANES * STEPS].reshape(full, STEPS, LANES))
        if len(rest := ids[full * LANES * STEPS :]):
            steps = -(-len(rest) // LANES)
            parts.append(np.concatenate((rest, np.full(steps * LANES - len(rest), self.pad, ids.dtype))).reshape(1, steps, LANES))
        words, offsets, states, sums, begin = [], [], [], [], 0
        for p in parts:
            if not self.f[p].all():
                raise ValueError("an id is not in the frequency table")
            w, counts, kept = self._encode(p)
            at = begin + np.concatenate(([0], np.cumsum(counts.reshape(-1))))[:-1].reshape(counts.shape)
            offsets.append(at[:, ::CHECK].reshape(-1))
            states.append(kept.reshape(-1))
            sums.extend(zlib.crc32(b.astype("<u4").tobytes()) for b in p)
            words.append(w)
            begin += len(w)
        cat = lambda xs, kind: np.concatenate(xs).astype(kind).tobytes() if xs else b""
        body = (_HEAD.pack(_MAGIC, SCALE, len(ids), len(sums), begin) + np.array(sums, "<u4").tobytes()
                + cat(offsets, "<u4") + cat(states, "<u8") + cat(words, "<u4"))
        return body + struct.pack("<I", zlib.crc32(body))

    def unpack(self, data: bytes) -> np.ndarray:
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("token block: checksum of the packed bytes differs")
        magic, scale, n, blocks, n_words = _HEAD.unpack_from(data)
        if magic != _MAGIC or scale != SCALE:
            raise ValueError("not a token block of this format")
        full = n // (LANES * STEPS)
        last = -(-(n - full * LANES * STEPS) // LANES)
        place = _HEAD.size

        def read(kind, count):
            nonlocal place
            out = np.frombuffer(data, kind, count, place)
            place += out.nbytes
            return out

        sums = read("<u4", blocks)
        points = full * (STEPS // CHECK) + -(-last // CHECK)
        offsets, states = read("<u4", points).astype(np.int64), read("<u8", points * LANES).reshape(points, LANES)
        words = np.append(read("<u4", n_words), np.zeros(1, "<u4")).astype(np.uint64)
        lengths = np.full(points, CHECK, np.int64)
        if last:
            lengths[-1] = last - CHECK * ((last - 1) // CHECK)
        out = np.zeros((points, CHECK, LANES), np.uint32)
        some = np.arange(points)
        x, at = states.copy(), offsets.copy()
        mask_slot, scale_ = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for s in range(CHECK):
            if lengths[-1:].size and lengths[-1] == s and len(some) == points and s < CHECK:
                some, x, at = some[:-1], x[:-1], at[:-1]
            if not len(some):
                break
            slot = x & mask_slot
            one = self.symbol[slot]
            out[some, s] = one
            x = self.f[one] * (x >> scale_) + slot - self.c[one]
            low = x < _LOW
            rank = np.cumsum(low, 1)
            fed = words[np.minimum(at[:, None] + rank - 1, n_words)]
            x = np.where(low, (x << np.uint64(32)) | fed, x)
            at = at + rank[:, -1]
        head = out[: full * (STEPS // CHECK)].reshape(-1)
        tail = out[full * (STEPS // CHECK) :].reshape(-1, LANES)[:last].reshape(-1)
        for i in range(blocks):
            block = head[i * LANES * STEPS : (i + 1) * LANES * STEPS] if i < full else tail
            if zlib.crc32(block.astype("<u4").tobytes()) != sums[i]:
                raise ValueError(f"token block {i}: checksum of the ids differs")
        return np.concatenate((head, tail))[:n]
