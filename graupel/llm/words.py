"""Words of a text as 64-bit hashes, computed on arrays of its bytes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D.  Hashes depend
on the word alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _bytes_at_random() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64)


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0x2545F4914F6CDD1D))
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _MUL2
    h = (h ^ (h >> np.uint64(29))) * _MUL
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of the words in an array of bytes, in order."""
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(first, sizes)
    size = 1 << max(8, int(sizes.max()).bit_length())
    terms = _bytes_at_random()[data[inside]] * _powers(size)[place]
    return mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64))


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def shingles(text: str, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``n`` words of a text in lower
    case (one run of all words where there are fewer), and its word hashes."""
    w = word_hashes(as_bytes(text.lower()))
    if not len(w):
        return w, w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = mixed(h + w[i : len(w) - k + 1 + i])
    return np.unique(h), w
