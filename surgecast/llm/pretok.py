"""Vectorised pre-tokenisation for the byte-level tokenizers.

``split`` cuts whole chunks of texts as these patterns do, from Unicode classes
looked up per code point (no regular expression runs over the texts):

* ``gpt``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``word``: ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` (white space dropped)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

from . import words as W

LETTER, NUMBER, OTHER, SPACE, END = range(5)
_END_POINT = 0x110000


def _points() -> tuple[str, np.ndarray]:
    points = [*range(0xD800), *range(0xE000, _END_POINT)]
    return "".join(map(chr, points)), np.array(points)


@cache
def classes() -> np.ndarray:
    """Class of every code point by Unicode; the document separator has its own."""
    text, points = _points()
    out = np.full(_END_POINT + 1, OTHER, np.uint8)
    for pattern, code in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = code
    out[_END_POINT] = END
    return out


@cache
def library_classes() -> np.ndarray:
    """The same by the tokenizers library, whose Unicode tables are of another age."""
    from tokenizers import Regex, pre_tokenizers

    text, points = _points()
    out = np.full(_END_POINT + 1, OTHER, np.uint8)
    for pattern, code in ((r"[^\p{L}]+", LETTER), (r"[^\p{N}]+", NUMBER), (r"[^\s]+", SPACE)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            out[points[a:b]] = code
    out[_END_POINT] = END
    return out


@cache
def library_lowered() -> np.ndarray:
    """Lower case of every code point by the tokenizers library.  U+0130, the one
    that becomes two, stands for itself here; replace it before."""
    from tokenizers import normalizers

    text, points = _points()
    out = np.arange(_END_POINT + 1, dtype=np.uint32)
    low = normalizers.Lowercase().normalize_str(text.replace("\u0130", ""))
    out[points[points != 0x130]] = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    return out


@dataclass
class Split:
    """Distinct pre-tokens ``words`` and, for each pre-token in text order, which
    of them it is (``which``); ``first[i]:first[i + 1]`` are those of text ``i``."""

    words: list[str]
    which: np.ndarray
    first: np.ndarray


def split(texts: list[str], pattern: str = "gpt", table: np.ndarray | None = None) -> Split:
    """Pre-tokens of ``texts`` by the classes of ``table`` (Unicode's if none); the
    ``word`` pattern lowers every code point first."""
    whole = "\0".join(texts) + "\0"
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
    if pattern == "word":
        cp = library_lowered()[cp]
        whole = cp.tobytes().decode("utf-32-le")
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    cp[at[1:] - 1] = _END_POINT
    kind = (classes() if table is None else table)[cp]
    n = len(cp)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    if pattern == "word":
        cut[:n] |= kind == NUMBER
    else:
        stop = np.flatnonzero(cut[1:n] & (kind[:-1] == SPACE) & (kind[1:] <= OTHER)) + 1
        cut[stop - 1] = True  # the last white-space character leaves its run
        cut[stop[cp[stop - 1] == 0x20]] = False  # and a blank joins what follows
    quote = np.flatnonzero(cp == 0x27)
    quote = quote[cut[quote] & cut[quote + 1]]
    one = quote[np.isin(cp[quote + 1], [ord(c) for c in "stmd"])]
    cut[one + 1], cut[one + 2] = False, True
    for a, b in ("re", "ve", "ll"):
        near = quote[cp[quote + 1] == ord(a)]
        two = near[cp[near + 2] == ord(b)]
        cut[two + 1], cut[two + 3] = False, True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    keep = kind[start] != END
    if pattern == "word":
        keep &= kind[start] != SPACE
    start, end = start[keep], end[keep]
    pw, inv = W._powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((cp.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0x9FB21C651E98DF25) * pw[:n], out=total[1:])
    value = (total[end] - total[start]) * inv[start]
    which, place = W.distinct(cp, start, end, value)
    words = [whole[a:b] for a, b in zip(start[place].tolist(), end[place].tolist())]
    return Split(words, which, np.searchsorted(start, at))


def runs(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of about ``limit`` characters; null is empty."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
