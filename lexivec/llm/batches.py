"""Array work on the texts of an Arrow batch: slices of bounded size, words, hashes, lookups.

Everything here runs inside a task on the rows that Spark hands it. A slice holds whole texts; it
exceeds ``SLICE`` bytes only when one text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the array code works on at once.
SLICE = 2 << 20

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word in the sense ``[^\x20\x09-\x0D]+``.
GRAPHIC = np.ones(256, dtype=bool)
GRAPHIC[[0x20, *range(0x09, 0x0E)]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes, equal hashes."""
    forward, backward = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * backward[starts])


class Words:
    """The words of one slice: byte spans, their row, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        inside = member[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        before[first] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[first[first > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.data = data
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def gather_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans end to end, and their offsets."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[index], offsets


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over bytes and offsets."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds, 0 where a row has none."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Lookup:
    """64-bit keys to their places 0..n-1 by open addressing; ``find`` gives -1 for the absent."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        self.mask = (1 << int(np.uint64(64) - self.shift)) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.places = np.full(self.mask + 1, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.places[slot] < 0
            self.places[slot[free]] = todo[free]  # of several keys for one slot the last one stays
            settled = self.places[slot] == todo
            self.keys[slot[settled]] = keys[todo[settled]]
            todo, slot = todo[~settled], (slot[~settled] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            place = self.places[slot]
            hit = (place >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = place[hit]
            on = (place >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out
