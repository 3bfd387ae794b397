"""Documents to shards by best-fit decreasing: groups of equal texts stay whole, shards get near equal bytes.

The size of a document is the UTF-8 bytes of its text plus 1; a group is all documents of one text, and its
size is their sum. Items, by falling size, enter the shard with the least remaining capacity that still
has room; remaining capacities are kept in a balanced tree (a B-tree of two levels), whose successor search
finds that shard. Two modes:

* ``capacity``: a shard is opened only when none has room, which keeps the number of shards small. A group
  larger than the capacity has a shard of its own.
* ``shards``: the least capacity is searched for which best-fit needs no more shards than that (bisection).
  A group larger than an equal share has a shard of its own, and the rest is shared by the others.

Scale. Group sizes come from one map-side combined aggregation. A group of at least 1 / ``ITEMS`` of all
bytes is an item of its own, of which there are at most ``ITEMS``; smaller groups join one of ``ITEMS``
parcels by the hash of their text, so best-fit sees at most twice that many items whatever the input. With a
capacity the groups are first dealt to districts of about ``WIDE`` shards by a hash of the text, and every
district is packed in a task of its own. A copy finds its shard by its item alone: no shuffle on the text,
and a text that a third of all rows share costs nothing more. Slots come from counts per written part and
shard, so no task sees a whole shard.

Defined results: a null text has no bytes and is grouped with the empty one; equal rows are documents each and get
slots of their own; null ids stay null; an empty table gives an empty table; further columns are ignored.
Two texts with one 64-bit hash would be one group, which keeps every property above.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.scratch import Scratch

#: Parcels of a district, and at most as many groups that are items of their own.
ITEMS = 1 << 15
#: Shards of a district on average, when a capacity is given.
WIDE = 1024
#: Entries of a leaf of the tree before it is split.
LEAF = 64


class Residuals:
    """(residual, shard) in order, in leaves that are split when full."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]  # a bound below each leaf

    def _leaf(self, entry: tuple[int, int]) -> int:
        k = bisect_left(self.least, entry)
        return k if k < len(self.least) and self.least[k] == entry else k - 1

    def add(self, entry: tuple[int, int]) -> None:
        k = self._leaf(entry)
        leaf = self.leaves[k]
        insort(leaf, entry)
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.least.insert(k + 1, leaf[half])

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least residual of at least ``room``."""
        k = self._leaf((room, -1))
        at = bisect_left(self.leaves[k], (room, -1))
        while at == len(self.leaves[k]):
            k, at = k + 1, 0
            if k == len(self.leaves):
                return None
        entry = self.leaves[k].pop(at)
        if not self.leaves[k] and k > 0:
            del self.leaves[k], self.least[k]
        return entry


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The shard of each size, the sizes falling; None if more than ``most`` shards are needed."""
    tree, out, opened = Residuals(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if opened == most:
                return None
            found = (max(capacity, size), opened)
            opened += 1
        out.append(found[1])
        tree.add((found[0] - size, found[1]))
    return out


def even(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, the sizes falling, at the least capacity for which best-fit needs ``shards``."""
    total, alone = sum(sizes), 0
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, left = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(-(-total // left), rest[0])
    high = low + rest[0]  # always enough: a size that does not fit would find every shard above an equal share
    best = best_fit(rest, high, left)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, left)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return [*range(alone), *(alone + s for s in best)]


def _district(capacity: int | None, shards: int | None):
    def run(table: pa.Table) -> pa.Table:
        size, item = table.column("bytes").to_numpy(), table.column("item").to_numpy()
        order = np.lexsort((item, -size))
        sizes = size[order].tolist()
        placed = best_fit(sizes, capacity) if shards is None else even(sizes, shards)
        table = table.take(pa.array(order))
        return pa.table([table.column(k) for k in ("district", "own", "item")] + [pa.array(placed, pa.int32())],
                        ["district", "own", "item", "local"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task with its number and their place among its rows of one shard."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column(3).to_numpy()
        place = np.zeros(len(batch), np.int64)
        order = np.argsort(shard, kind="stable")
        values, first, counts = np.unique(shard[order], return_index=True, return_counts=True)
        for value, lo, n in zip(values.tolist(), first.tolist(), counts.tolist(), strict=True):
            place[order[lo : lo + n]] = seen.get(value, 0) + np.arange(n)
            seen[value] = seen.get(value, 0) + n
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"]
        )


def shard_documents(
    docs: DataFrame, shards: int | None = None, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of ``docs`` in its shard, slots without gaps from 0.

    Give either the number of ``shards`` (equal bytes, 0 to shards - 1) or the ``capacity`` of one in bytes.
    """
    if (shards is None) == (capacity is None) or (capacity if shards is None else shards) < 1:
        raise ValueError("give a positive number of shards or a positive capacity")
    kind = docs.schema[doc_id].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    districts = 1 if capacity is None else max(1, -(-total // (capacity * WIDE)))
    # An item: a group of its own by its key, or the parcel of a small group.
    district = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(districts)).alias("district")
    parcel = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(ITEMS)).alias("parcel")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).select("*", district, parcel)
    own = F.col("bytes") >= F.lit(total / (ITEMS * districts))
    items = groups.select("district", own.alias("own"), F.when(own, F.col("key")).otherwise(F.col("parcel")).alias("item"), "bytes")
    items = items.groupBy("district", "own", "item").agg(F.sum("bytes").alias("bytes"))
    plan = scratch.write(
        items.groupBy("district").applyInArrow(_district(capacity, shards), "district bigint, own boolean, item bigint, local int"),
        "plan",
    )
    opened = plan.groupBy("district").agg((F.max("local") + 1).alias("n"))
    before = Window.orderBy("district").rowsBetween(Window.unboundedPreceding, -1)  # one row a district
    first = opened.select(F.col("district").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if districts == 1:
        first = opened.select(F.col("district").alias("d"), F.lit(0).alias("first"))
    plan = plan.join(first, F.col("district") == F.col("d")).select(
        "district", "own", "item", (F.col("first") + F.col("local")).cast("int").alias("shard")
    )
    big = plan.filter("own").select(F.col("item").alias("k"), F.col("shard").alias("s"))
    small = plan.filter("not own").select(F.col("district").alias("d"), F.col("item").alias("p"), F.col("shard").alias("t"))
    if districts == 1:  # at most ITEMS rows each
        big, small = F.broadcast(big), F.broadcast(small)
    found = rows.select("*", district, parcel).join(big, F.col("key") == F.col("k"), "left").join(
        small, F.col("s").isNull() & (F.col("district") == F.col("d")) & (F.col("parcel") == F.col("p")), "left"
    ).select("doc_id", "size", "text_crc32", F.coalesce("s", "t").alias("shard"))
    placed = scratch.write(
        found.mapInArrow(_places, f"doc_id {kind}, size bigint, text_crc32 bigint, shard int, part int, place bigint"), "placed"
    )
    scratch.drop("rows")
    scratch.drop("plan")
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = counts.select(
        F.col("part").alias("q"), F.col("shard").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    return placed.join(starts, (F.col("part") == F.col("q")) & (F.col("shard") == F.col("s"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot")
    )


def digest(result: DataFrame) -> DataFrame:
    """The result of ``shard_documents`` with the law it keeps."""
    return result.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
