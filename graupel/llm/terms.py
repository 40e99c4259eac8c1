"""Terms of many texts at once, found on the byte buffers of an Arrow column.

A term is a run of the letters A to Z in either case and of bytes from 0x80 on,
so of all characters beyond ASCII; only A to Z are folded to lower case.  One
look-up table says of each byte whether it belongs to a term and what it folds
to; no term spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

from .words import mixed

#: Byte to folded byte; 0 where the byte is part of no term.
FOLD = np.zeros(256, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[65:91] = FOLD[97:123] = np.arange(97, 123)

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets, from 0, and the bytes of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data


def packed(batches, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of ``column`` take at most ``size``
    bytes together, or are one text."""
    for batch in batches:
        if not len(batch):
            continue
        ends = buffers(batch.column(column))[0]
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


class Terms:
    """The terms of a string column without nulls: ``data`` (folded bytes) with
    ``starts``, ``ends`` and the number of the text, ``row``, of each term."""

    def __init__(self, column: pa.Array):
        offsets, raw = buffers(column)
        self.data = FOLD[raw]
        inside = self.data != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1

    def hashes(self) -> np.ndarray:
        said, digest = self.data.tobytes(), xxhash.xxh3_64_intdigest
        return np.fromiter((digest(said[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist())), np.uint64, len(self.starts))

    @cached_property
    def words(self) -> np.ndarray:
        """The eight bytes from each byte on, as one number (no copy of each)."""
        wide = np.concatenate((self.data, np.zeros(8, np.uint8)))
        return np.ndarray((len(self.data) + 1,), "<u8", wide, 0, (1,))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of at least ``size`` bytes, and a hash of their first ``size`` (1 to 8) bytes."""
        long = np.flatnonzero(self.ends - self.starts >= size)
        return long, mixed((self.words[self.starts[long]] & _MASKS[size]) + np.uint64(size))

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether terms i and j have the same bytes, eight bytes at a time."""
        words = self.words
        sizes = self.ends[i] - self.starts[i]
        equal = sizes == self.ends[j] - self.starts[j]
        left = np.flatnonzero(equal)
        done = 0
        while len(left):
            mask = _MASKS[np.minimum(sizes[left] - done, 8)]
            differ = ((words[self.starts[i[left]] + done] ^ words[self.starts[j[left]] + done]) & mask) != 0
            equal[left[differ]] = False
            done += 8
            left = left[~differ & (sizes[left] > done)]
        return equal

    def strings(self, i: np.ndarray) -> pa.Array:
        """The terms numbered by ``i`` as an Arrow string array."""
        sizes = self.ends[i] - self.starts[i]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(self.starts[i], sizes)
        return pa.Array.from_buffers(pa.string(), len(i), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[place])])
