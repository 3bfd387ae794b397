"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Two documents conflict when they share a source or a duplicate cluster; conflicting documents never share
a bin. A document longer than a bin gives full pieces with a bin each, and a rest. Rests are placed by
falling length. Open bins are ordered by residual and carry bitmaps of their sources and clusters; the
successor search begins at the smallest residual that fits and continues, residual by residual, until it
reaches the tightest bin without a conflict, and opens a bin only when there is none.

Documents are dealt by a hash to shards of about ``SHARD`` documents, so sources and clusters, however
large, are spread evenly; each shard is one task's work and a bin belongs to one shard. Packing into one
shard or many differs by less than a bin per length and shard.

Defined results: a null or empty text has one token, its end; a null source or cluster conflicts with
nothing; equal rows of one id are packed each, in different bins when they have a source or cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a bin.
CAPACITY = 2048
#: Documents of a shard on average.
SHARD = 20_000

_WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins of one shard, by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.by_residual: dict[int, dict[int, list[int]]] = {}  # residual, bitmap of sources: bins
        self.count = np.zeros(capacity + 1, np.int32)  # bins of a residual
        self.count_with: dict[int, np.ndarray] = {}  # those of them that hold a source

    def _with(self, source: int) -> np.ndarray:
        if source not in self.count_with:
            self.count_with[source] = np.zeros(self.capacity + 1, np.int32)
        return self.count_with[source]

    def _bits(self, bitmap: int) -> list[int]:
        out = []
        while bitmap:
            low = bitmap & -bitmap
            out.append(low.bit_length() - 1)
            bitmap ^= low
        return out

    def _list(self, b: int, sign: int) -> None:
        r, held = self.residual[b], self.sources[b]
        self.count[r] += sign
        for source in self._bits(held):
            self._with(source)[r] += sign
        group = self.by_residual.setdefault(r, {})
        if sign > 0:
            insort(group.setdefault(held, []), b)
        else:
            bins = group[held]
            del bins[bisect_left(bins, b)]
            if not bins:
                del group[held]

    def find(self, length: int, source: int | None, clusters: int) -> int | None:
        """The tightest compatible bin, the oldest of equals; None if there is none."""
        free = self.count[length:]
        if source is not None and source in self.count_with:
            free = free - self.count_with[source][length:]
        bit = 0 if source is None else 1 << source
        for r in (np.flatnonzero(free) + length).tolist():
            best = None
            for held, bins in self.by_residual[r].items():
                if held & bit:
                    continue
                for b in bins:
                    if best is not None and b > best:
                        break
                    if not self.clusters[b] & clusters:
                        best = b
                        break
            if best is not None:
                return best
        return None

    def place(self, length: int, source: int | None, clusters: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        b = self.find(length, source, clusters)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._list(b, -1)
        offset = self.capacity - self.residual[b]
        self.residual[b] -= length
        self.sources[b] |= 0 if source is None else 1 << source
        self.clusters[b] |= clusters
        if self.residual[b]:  # a full bin is closed
            self._list(b, 1)
        return b, offset


def _numbered(values: list) -> list[int | None]:
    names: dict = {}
    return [None if v is None else names.setdefault(v, len(names)) for v in values]


def _packer(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("cluster", "ascending")])
        lengths = table.column("n_tokens").to_pylist()
        sources = _numbered(table.column("source").to_pylist())
        shard = table.column("shard")[0].as_py()
        clusters = table.column("cluster").to_pylist()
        seen: dict = {}
        for c in clusters:
            seen[c] = seen.get(c, 0) + 1
        clusters = _numbered([c if c is not None and seen[c] > 1 else None for c in clusters])
        bins = Bins(capacity)
        rows, pieces, starts, sizes, places, offsets = [], [], [], [], [], []
        order = sorted(range(len(lengths)), key=lambda k: -((lengths[k] - 1) % capacity + 1))
        for k in order:
            bit = 0 if clusters[k] is None else 1 << clusters[k]
            full, rest = divmod(lengths[k], capacity)
            for piece in range(full + (rest > 0)):
                size = capacity if piece < full else rest
                b, offset = bins.place(size, sources[k], bit)
                rows.append(k)
                pieces.append(piece)
                starts.append(piece * capacity)
                sizes.append(size)
                places.append((shard << 32) | b)
                offsets.append(offset)
        return pa.table(
            {"doc_id": table.column("doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(pieces, pa.int32()),
             "token_start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
             "bin_id": pa.array(places, pa.int64()), "bin_offset": pa.array(offsets, pa.int64())}
        )

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", source: str = "source", cluster: str = "cluster",
    capacity: int = CAPACITY, shard: int = SHARD,
) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, bin_id, bin_offset): a row per piece of a document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard))
    spread = F.pmod(F.xxhash64(doc_id, cluster, n_tokens), F.lit(shards))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.greatest(F.col(n_tokens), F.lit(1)), F.lit(1)).cast("bigint").alias("n_tokens"),
        F.col(source).alias("source"), F.col(cluster).alias("cluster"), spread.alias("shard"),
    )
    return rows.groupBy("shard").applyInArrow(
        _packer(capacity),
        f"doc_id {kind}, piece int, token_start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint",
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words and an end) and cluster (texts that differ in case or spaces share it)."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0))
    plain = F.regexp_replace(F.lower(F.col(text)), r"[\x20\x09-\x0D]+", " ")
    return docs.withColumn("n_tokens", words + 1).withColumn("cluster", F.when(F.col(text).isNotNull(), F.xxhash64(plain)))
