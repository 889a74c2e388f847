"""Vectorised word scanning shared by the operators of this subpackage.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text,
with A-Z lowered.  A whole chunk of documents is scanned at once in numpy; every
word gets a 64-bit hash that depends on its bytes alone, so equal words hash
alike in every task.  Eight bytes at a time are mixed into it, so no pattern of bytes
makes unequal words alike (as sums of powers of a base do); ``distinct`` tells words
apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

CHUNK_BYTES = 1 << 19  # text bytes scanned together (in cache); a longer document is a chunk of its own

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
_LONG = 512  # bytes from which a word is hashed by itself
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("_pow", _BASE), ("_inv", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """``start``/``end`` are byte places in ``data``; ``first[i]:first[i + 1]`` are
    the words of document ``i`` of the chunk, whose bytes begin at ``at[i]``."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def scan(texts: list[bytes], fold: bool = True) -> Words:
    """Words of all texts, one chunk; without ``fold``, hashes tell A-Z from a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    inside = (data - np.uint8(9) > 4) & (data != 0x20)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    return Words(data, at, start, end, hashes(data, start, end, fold), np.searchsorted(start, at))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of the words at ``start:end``."""
    raw = data.tobytes()
    if fold:
        raw = raw.lower()  # bytes.lower is A-Z alone
    raw += bytes(8)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from every place on
    length = end - start
    out = mix((eights[start] & _LANE[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(_BASE))
    more = np.flatnonzero((length > 8) & (length < _LONG))
    at = 8
    while len(more):
        lane = eights[start[more] + at] & _LANE[np.minimum(length[more] - at, 8)]
        out[more] = mix((out[more] ^ lane) * np.uint64(_BASE) + np.uint64(at))
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length >= _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def equal(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether each word of ``a`` and the word of ``b`` beside it hold the same bytes."""
    size = a_end - a_start
    out = size == b_end - b_start
    some = np.flatnonzero(out)
    if len(some):
        size = size[some]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        out[some] = np.logical_and.reduceat(a[at + np.repeat(a_start[some], size)] == b[at + np.repeat(b_start[some], size)], first)
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct words every word is, and the place of each one's first
    occurrence: grouped by hash, then compared item by item of ``data``."""
    which, found = pd.factorize(hash_)
    place = np.empty(len(found), np.int64)
    place[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    length, model = end - start, place[which]
    same = bool((length == length[model]).all())
    if same and len(which):
        again = np.flatnonzero(model != np.arange(len(which)))  # first occurrences are themselves
        size = length[again]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        same = bool((data[at + np.repeat(start[again], size)] == data[at + np.repeat(start[model[again]], size)]).all())
    if not same:  # two words of one hash: by the words themselves
        raw, width = data.tobytes(), data.itemsize
        which, found = pd.factorize(np.array([raw[a * width : b * width] for a, b in zip(start.tolist(), end.tolist())], dtype=object))
        place = np.empty(len(found), np.int64)
        place[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return which, place


def chunks(texts: list[bytes | str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """``(index of the first, texts as bytes)`` in runs of about ``limit`` bytes; null is empty."""
    begin, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = b"" if t is None else t.encode() if isinstance(t, str) else t
        if run and size + len(t) > limit:
            yield begin, run
            begin, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield begin, run


def shingles(w: Words, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their document; ``whole``: a
    document of fewer words has its whole sequence as its only one."""
    n = np.diff(w.first)
    salt = _rng_salts(width)
    h, m = w.hash, len(w.hash)
    if m >= width:
        roll = np.zeros(m - width + 1, np.uint64)
        for j in range(width):
            roll += h[j : m - width + 1 + j] * salt[j]
        roll = mix(roll)
    else:
        roll = np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    ok = doc[: len(roll)] == doc[width - 1 :] if len(roll) else np.zeros(0, bool)
    value, owner = roll[ok], doc[: len(roll)][ok]
    if whole and (short := np.flatnonzero((n > 0) & (n < width))).size:
        few = []
        for i in short:
            x = h[w.first[i] : w.first[i + 1]]
            few.append(mix((x * salt[: len(x)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0])
        value = np.concatenate((value, np.array(few, np.uint64)))
        owner = np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def _rng_salts(width: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
