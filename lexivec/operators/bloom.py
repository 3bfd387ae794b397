"""Semi and anti joins behind a Bloom filter: most rows without a partner are decided before the shuffle.

The filter is built over the keys by their hashes: every task sets the bits of its keys, the parts are put together by
OR in two steps, and the result, of bounded size, goes to every task. A row whose hash is not in it has no
partner, for certain; only the other rows are shuffled, and an exact join decides them. So the rows are those of the
plain join, whatever the filter lets through. It pays where most rows have no partner and both sides are large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, PROBES = 12, 4  # lets through some 0.5% of the rows without a partner
MOST_BITS = 1 << 27  # 16 MB for every task; with more keys the filter lets more rows through
SEGMENT = 1 << 16  # bytes of a part that tasks put together
WAYS = 16  # parts are put together in so many groups first


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash, a row per probe; ``bits`` is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


def _setter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One filter per task, cut into segments that have a bit."""
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy().view(np.uint64)
            for at in _positions(hashes, bits):
                np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for segment in range(-(-len(field) // SEGMENT)):
            part = field[segment * SEGMENT : (segment + 1) * SEGMENT]
            if part.any():
                way = TaskContext.get().partitionId() % WAYS
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), pa.array([way], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                    ["segment", "way", "bits"],
                )

    return run


def _either(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")]
    return pa.table({"segment": table.column("segment")[:1], "way": pa.array([0], pa.int32()), "bits": [np.bitwise_or.reduce(parts).tobytes()]})


def bloom_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """A column function: may the value be one of the keys? Never false for a key; a null is none."""
    n = keys.filter(F.col(key).isNotNull()).count()
    bits = max(64, min(most_bits, 1 << max(n * BITS_PER_KEY - 1, 1).bit_length()))
    shape = "segment int, way int, bits binary"
    parts = keys.select(F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("h")).mapInArrow(_setter(bits), shape)
    whole = parts.groupBy("segment", "way").applyInArrow(_either, shape).groupBy("segment").applyInArrow(_either, shape)
    field = np.zeros(bits // 8, np.uint8)
    for row in whole.collect():  # at most MOST_BITS in all
        begin = row["segment"] * SEGMENT
        field[begin : begin + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(field)

    def probe(hashes: pa.Array) -> pa.Array:
        known = hashes.is_valid().to_numpy(zero_copy_only=False)
        values = hashes.fill_null(0).to_numpy().view(np.uint64)
        for at in _positions(values, bits):
            known = known & ((shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return pa.array(known)

    maybe = F.arrow_udf(probe, "boolean")
    return lambda value: maybe(F.when(value.isNotNull(), F.xxhash64(value)))


def semi_join(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose key is one of the keys; a null key has no partner."""
    maybe = bloom_filter(keys, key, most_bits)
    return rows.filter(maybe(F.col(key))).join(keys.select(key).distinct(), key, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose key is none of the keys, also those with a null key; the certain ones stay where they are."""
    maybe = bloom_filter(keys, key, most_bits)
    certain = rows.filter(~maybe(F.col(key)))
    return certain.unionByName(rows.filter(maybe(F.col(key))).join(keys.select(key).distinct(), key, "left_anti"))


def filter_report(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """One row ``(n_rows, n_shuffled, n_matched)``: all rows, those that go on to the exact join, and its result."""
    maybe = bloom_filter(keys, key, most_bits)
    passed = rows.filter(maybe(F.col(key)))
    matched = passed.join(keys.select(key).distinct(), key, "left_semi")
    counts = [t.agg(F.count(F.lit(1)).alias(c)) for t, c in ((rows, "n_rows"), (passed, "n_shuffled"), (matched, "n_matched"))]
    return counts[0].join(counts[1]).join(counts[2])
