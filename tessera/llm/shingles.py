"""Hashes of word shingles, computed over whole batches of text with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = _BYTE[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 20)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)], dtype=np.uint64)


_POWERS = Powers()


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) for texts that begin at starts in data; A-Z count as a-z."""
    n = len(data)
    _POWERS.to(n + 1)
    space = _SPACE[data]
    begin = ~space
    # A word begins after white space or where a text begins.
    head = begin.copy()
    head[1:] &= space[:-1]
    first = starts[starts < n]
    head[first] = begin[first]
    tail = begin.copy()
    tail[:-1] &= space[1:]
    last = first[first > 0] - 1
    tail[last] = begin[last]
    s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS.up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * _POWERS.down[s] + (e - s).astype(np.uint64) * _ODD[60])
    counts = np.diff(np.searchsorted(s, np.r_[starts, n]))
    return h, counts


def shingle_sets(texts: pa.Array, words: int, chunk_bytes: int = 1 << 19) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (uint64) of its runs of that many words; the whole sequence if it has fewer words.

    Words are runs without white space (ASCII), A-Z counts as a-z. Null, empty and blank texts have an empty set.
    """
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = np.asarray(pa.compute.binary_length(texts), np.int64)
    ends = np.cumsum(sizes)
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // chunk_bytes)) + 1, len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        part = texts.slice(int(a), int(b - a))
        data = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
        starts = np.r_[0, np.cumsum(sizes[a:b])[:-1]].astype(np.int64)
        h, counts = word_hashes(data, starts)
        rolled = np.zeros(len(h), np.uint64)
        for k in range(words):
            rolled[: len(h) - k] += h[k:] * _ODD[k]
        rolled = mix(rolled)
        at = 0
        for n in counts.tolist():
            if n >= words:
                yield np.unique(rolled[at : at + n - words + 1])
            elif n:
                yield mix((h[at : at + n] * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + _ODD[61:62] * np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            at += n
