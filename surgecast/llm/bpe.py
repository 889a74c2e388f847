"""Byte-pair merging of single words."""

from __future__ import annotations

import heapq
from collections.abc import Callable

_NONE = 1 << 62
_SHORT = 64


def merge(word: bytes, rank: Callable[[bytes, bytes], int | None]) -> list[bytes]:
    """Parts of ``word`` after merging, again and again, the adjacent pair of the
    lowest rank (the leftmost of equals)."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) < 2:
        return parts
    if len(parts) > _SHORT:
        return _merge_long(parts, rank)
    ranks = [_NONE if (r := rank(a, b)) is None else r for a, b in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == _NONE:
            break
        i = ranks.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = _NONE if (r := rank(parts[i - 1], parts[i])) is None else r
        if i < len(ranks):
            ranks[i] = _NONE if (r := rank(parts[i], parts[i + 1])) is None else r
    return parts


def _merge_long(parts: list[bytes], rank: Callable[[bytes, bytes], int | None]) -> list[bytes]:
    """The same for long words: a heap of pairs over a linked list."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (r := rank(parts[x], parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [p for p in parts if p is not None]


def by_concatenation(ranks: dict[bytes, int]) -> Callable[[bytes, bytes], int | None]:
    """Pair ranks of a vocabulary given as ranked byte strings."""
    return lambda a, b: ranks.get(a + b)


def by_pair(pairs: dict[tuple[bytes, bytes], int]) -> Callable[[bytes, bytes], int | None]:
    """Pair ranks of a list of merges."""
    return lambda a, b: pairs.get((a, b))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
