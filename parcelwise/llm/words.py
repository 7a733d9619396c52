"""Words of whole Arrow text columns, found on the UTF-8 bytes at once.

A word is a longest run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end and the offsets of the texts (one more than texts); null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    buffers = array.buffers()
    if not len(array) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's text, one more so that empty rows count."""
    return 1 + pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """The words of a text column: where each starts and ends in ``data``, its text, and how many each text has."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False):
        data, offsets = text_bytes(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        first, last = np.ones(len(data), bool), np.ones(len(data), bool)
        first[1:] = gap[:-1]
        first[edge] = True
        last[:-1] = gap[1:]
        last[edge[1:] - 1] = True
        self.data, self.word = data, ~gap
        self.start = np.flatnonzero(self.word & first)
        self.end = np.flatnonzero(self.word & last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.base = np.cumsum(self.count) - self.count

    def hashes(self, other: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``other``: by a second function that shares nothing with the first."""
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        powers = np.full(int(length.max()), MULTIPLIERS[other], np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        return mixed(np.add.reduceat(BYTE_VALUES[int(other)][self.data[self.word]] * powers[place], begin))

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text joined by one space: bytes end to end, each word followed by one more byte, and the end of each kept word before it."""
        kept = np.ones(len(self.start), bool) if keep is None else keep
        length = (self.end - self.start)[kept]
        index = np.repeat(self.start[kept] - (np.cumsum(length + 1) - length - 1), length + 1) + np.arange(int((length + 1).sum()))
        ends = np.cumsum(length + 1) - 1
        out = self.data[np.minimum(index, max(len(self.data) - 1, 0))] if len(index) else np.zeros(0, np.uint8)
        out[ends] = 32
        return out, ends

    def texts(self, keep: np.ndarray) -> pa.Array:
        """The kept words of each text joined by one space."""
        data, ends = self.joined(keep)
        n = np.bincount(self.doc[keep], minlength=len(self.count))
        last = np.cumsum(n)
        stop = np.where(last > 0, ends[np.maximum(last - 1, 0)] if len(ends) else 0, 0)
        begin = np.r_[0, np.where(last > 0, stop + 1, 0)[:-1]] if len(n) else np.zeros(0, np.int64)
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") if k else "" for a, b, k in zip(begin.tolist(), stop.tolist(), n.tolist(), strict=True)], pa.string())


MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: Words, size: int, hashes: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``size`` words of one text: the index of its first word and a hash of its word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(multiplier)
        out += hashes[j : j + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return at, mixed(out[at])
