"""Chunks of texts as Arrow arrays, used inside tasks: runs without whitespace, and single whitespace bytes.

Chunks lie one after the other, so an array of them is one of offsets into the bytes of the texts; splitting, and telling
the distinct ones apart, costs no Python object per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\f\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def text_slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in parts of about ``size`` bytes, a longer one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        begin = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, ends, data = texts.buffers()
    width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(ends, width)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, width)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[ends[0] : ends[-1]], ends.astype(np.int64) - ends[0]


def bytes_read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each read up to its first NUL, one after the other, and where each begins, and the end.

    A null has no bytes.
    """
    data, ends = _bytes_of(pc.fill_null(texts, b"") if texts.null_count else texts)
    if not data.all():
        data, ends = _bytes_of(pa.array([(t or b"").split(b"\0", 1)[0] for t in texts.to_pylist()], pa.large_binary()))
    return data, ends


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, each read up to its first NUL, and the number of the first chunk of every text, and the end.

    A null has no chunks.
    """
    data, ends = bytes_read(texts)
    space = _IS_SPACE[data]
    fresh = space.copy()
    fresh[1:] |= space[:-1]
    fresh[ends[:-1][ends[:-1] < ends[1:]]] = True
    begins = np.append(np.flatnonzero(fresh), len(data))
    buffers = [None, pa.py_buffer(begins), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, buffers), np.searchsorted(begins, ends)


def spelled_out(which: np.ndarray, coded: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks, one after the other, and where those of each text begin, and the end.

    ``coded`` has the packed 32-bit ids of the distinct chunks, ``which`` tells the one of every chunk and ``bounds``
    the first chunk of every text.
    """
    widths = np.array([len(c) // 4 for c in coded], np.int64)
    sizes = widths[which]
    ends = np.cumsum(sizes)
    place = (np.cumsum(widths) - widths)[which] - (ends - sizes)
    ids = np.frombuffer(b"".join(coded), np.int32)[np.arange(sizes.sum()) + np.repeat(place, sizes)]
    return ids, np.append(0, ends)[bounds]
