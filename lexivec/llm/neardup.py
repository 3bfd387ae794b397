"""Near-duplicate documents: an LSH forest proposes, full shingle sets decide.

A document is the set of its distinct word shingles. Documents with equal sets form a class and go on
as its smallest id. ``TREES`` orders sort the classes by a label of ``LEVELS`` MinHash values of 16 bits;
neighbours in an order whose labels share a prefix of ``DEPTH`` values or more are candidates. Range
partitions sort the orders, so equal labels of any number are spread over many tasks; the first and last
rows of the partitions are compared as well, so no pair and no region is lost where two of them meet.

* First links: candidates are ranked by the share of equal signature values (those below ``FLOOR`` wait for
  the completion); per document its two best are compared on full sets, and components formed.
* Completion: neighbours are not all partners. Documents of a region (documents of an order with a common
  prefix) that has several components are open, if their sets leave room for the similarity once the
  shingles that only one document has are set aside. Open documents whose regions overlap are a family. Every two
  blocks of a family meet once, whatever the number of orders they share, with their whole sets: one task
  counts the common shingles of all their pairs by matrix products, and returns only the links that join
  two components which it had not joined before.

A pair of similarity 0.8 shares no region of depth ``DEPTH`` with probability (1 - 0.8^4)^32 = 5e-8; higher similarities
are lost less often. Nothing else is lost: families are compared in full, with no limit on their size.

Defined results: null or empty texts have no shingles, are their own component and are kept; a text with
fewer words than a shingle is one shingle; equal rows of one id count as one document and stay equal rows;
rows with a null id have a null component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lexivec.llm.batches import GRAPHIC, LOWER, Words, mix, slices, text_bytes
from lexivec.llm.components import components
from lexivec.scratch import Scratch

#: Words per shingle and the similarity of a link, in hundredths.
WIDTH, PERCENT = 5, 80
#: Sorted orders, MinHash values per label, least common prefix.
TREES, LEVELS, DEPTH = 32, 6, 4
#: Least share of equal signature values of a pair that is compared on full sets.
FLOOR = 0.68
#: Documents of a block on average; two blocks meet in one place.
BLOCK = 256
#: Tasks that share the rows of one region or family where these meet its aggregate.
SALTS = 16
#: Shingles that a product of two blocks takes at once.
COLUMNS = 4096

_draw = np.random.default_rng(20250801)
_FACTORS = _draw.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32) | np.uint32(1)
_FLIPS = _draw.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)
_TERMS = _draw.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and the bounds of the texts."""
    words = Words(LOWER[data], offsets, GRAPHIC)
    hashed, counts = words.hashes(), words.counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    rows = np.repeat(np.arange(len(counts)), sizes)
    at = words.bounds[rows] + np.arange(bounds[-1]) - bounds[rows]
    length = np.minimum(counts[rows], width)
    total = length.astype(np.uint64)
    for k in range(width):
        full = k < length
        total += np.where(full, hashed[np.where(full, at + k, 0)] if len(hashed) else 0, 0).astype(np.uint64) * _TERMS[k]
    total = mix(total)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        total[lo:hi].sort()
    first = np.ones(len(total), bool)
    first[1:] = total[1:] != total[:-1]
    first[bounds[:-1][sizes > 0]] = True
    kept = np.zeros(len(total) + 1, np.int64)
    np.cumsum(first, out=kept[1:])
    return total[first], kept[bounds]


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits per set that do not depend on an order."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    sums = np.zeros(len(sets) + 1, np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.cumsum(mix(sets ^ np.uint64(salt)), out=sums[1:])
        out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each of the MinHash values of every nonempty set."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), TREES * LEVELS), np.uint16)
    if len(starts):
        short = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(TREES * LEVELS):
            least = np.minimum.reduceat((short ^ _FLIPS[k]) * _FACTORS[k], starts)
            out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    data, offsets = text_bytes(column)
    n = len(column)
    return np.frombuffer(data.tobytes(), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                sets, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
                sizes = np.diff(bounds)
                full = sizes > 0
                sketch = np.zeros((hi - lo, TREES * LEVELS), np.uint16)
                sketch[full] = signatures(sets, bounds)
                keys, sketch = _fixed(set_keys(sets, bounds)), _fixed(sketch)
                some = pa.array(full)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)),
                     pc.if_else(some, keys, None), pc.if_else(some, sketch, None)],
                    ["id", "n", "key", "sketch"],
                )

    return run


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class and order."""
    for batch in batches:
        sketch = _matrix(batch.column(2), np.uint16).reshape(-1, TREES, LEVELS).byteswap()
        for tree in range(TREES):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(batch), tree, np.int32)), _fixed(sketch[:, tree]), batch.column(0), batch.column(1)],
                ["tree", "label", "id", "n"],
            )


def _similar_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def _neighbours(percent: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a sorted partition: pairs of neighbours (b is set), members of regions (b is null), and its ends.

        The ends have the number of their partition, and whether they are members in it.
        """
        table = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
        if table is None or len(table) == 0:
            return
        table = table.combine_chunks()
        tree, n = (table.column(k).to_numpy() for k in ("tree", "n"))
        label = _matrix(table.column("label").combine_chunks(), np.uint16).reshape(len(table), LEVELS)
        ids = table.column("id").combine_chunks()
        shared = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1)
        near = (shared >= DEPTH) & (tree[1:] == tree[:-1])
        member = np.zeros(len(table), bool)
        member[1:] |= near
        member[:-1] |= near
        names = ["tree", "prefix", "label", "a", "b", "n", "part", "inside"]
        ends = np.unique([0, len(table) - 1])
        for at, part in ((np.flatnonzero(member), None), (ends, TaskContext.get().partitionId())):
            prefix = np.ascontiguousarray(label[at][:, :DEPTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree[at]), _fixed(prefix), _fixed(label[at]), ids.take(pa.array(at)),
                 pa.nulls(len(at), id_type), pa.array(n[at]), pa.array([part] * len(at), pa.int32()), pa.array(member[at])],
                names,
            )
        at = np.flatnonzero(near & _similar_sizes(n[1:], n[:-1], percent))
        one, two = ids.take(pa.array(at)), ids.take(pa.array(at + 1))
        swap = pc.greater(one, two)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()),
             pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.nulls(len(at), pa.int64()),
             pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.bool_())],
            names,
        )

    return run


def _proposed(orders: DataFrame, percent: int, id_type: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of sorted range partitions: members of regions (tree, prefix, label, id, n) and pairs (a, b) of neighbours."""
    arrow_id = to_arrow_type(orders.schema["id"].dataType)
    kinds = f"tree int, prefix binary, label binary, a {id_type}, b {id_type}, n bigint, part int, inside boolean"
    near = scratch.write(orders.mapInArrow(_neighbours(percent, arrow_id), kinds), "neighbours")
    members = near.filter("b is null and part is null").select("tree", "prefix", "label", F.col("a").alias("id"), "n")
    pairs = near.filter("b is not null").select("a", "b")
    ends = near.filter("part is not null").drop("b").collect()  # two rows a partition
    ends.sort(key=lambda r: (r["tree"], bytes(r["label"]), r["a"], r["part"]))
    entered, met = {}, set()
    for k, (x, y) in enumerate(pairwise(ends)):
        if x["part"] != y["part"] and x["tree"] == y["tree"] and x["prefix"] == y["prefix"]:
            entered |= {j: r for j, r in ((k, x), (k + 1, y)) if not r["inside"]}
            if min(x["n"], y["n"]) * 100 >= max(x["n"], y["n"]) * percent:
                met.add((min(x["a"], y["a"]), max(x["a"], y["a"])))
    spark = orders.sparkSession
    if entered:
        rows = [(r["tree"], bytes(r["prefix"]), bytes(r["label"]), r["a"], r["n"]) for r in entered.values()]
        members = members.unionByName(spark.createDataFrame(rows, members.schema))
    if met:
        pairs = pairs.unionByName(spark.createDataFrame(sorted(met), pairs.schema))
    return members, pairs.distinct()


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (_matrix(batch.column(k), np.uint16) for k in (2, 3))
        share = (one == two).mean(axis=1) if len(batch) else np.zeros(0)
        kept = pa.array(share >= FLOOR)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "share"])
        yield out.filter(kept)


def _confirmer(width: int, percent: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of two blocks: their texts come first, then the pairs; those whose full sets are similar enough go on."""
        for table in _groups(batches, 2):
            sets: dict = {}
            ones, twos = [], []
            for batch in table.to_batches():
                ids, others = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                data, offsets = text_bytes(batch.column(4))
                for lo, hi in slices(offsets):
                    part = offsets[lo : hi + 1]
                    found, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
                    for row in range(lo, hi):
                        if others[row] is None:
                            sets[ids[row]] = found[bounds[row - lo] : bounds[row - lo + 1]]
                            continue
                        x, y = sets[ids[row]], sets[others[row]]
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if common and 100 * common >= percent * (len(x) + len(y) - common):
                            ones.append(ids[row])
                            twos.append(others[row])
            yield pa.RecordBatch.from_arrays([pa.array(ones, id_type), pa.array(twos, id_type)], ["a", "b"])

    return run


def _own_texts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text has the set of the class; another text under the same id has not."""
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            wanted = _matrix(batch.column(2), np.uint64)
            same = np.zeros(len(batch), bool)
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                found = set_keys(*shingle_sets(data[part[0] : part[-1]], part - part[0], width))
                same[lo:hi] = (found == wanted[lo:hi]).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"]).filter(pa.array(same))

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; ids are of any type with an order."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    id_type = docs.schema[doc_id].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema[doc_id].dataType)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = scratch.write(
        texts.mapInArrow(_sketcher(width), f"id {id_type}, n bigint, key binary, sketch binary"), "sketches"
    )
    leader = F.min(F.struct("id", "n", "sketch")).alias("c")
    classes = scratch.write(
        rows.filter("key is not null and id is not null").groupBy("key").agg(leader).select("c.*", "key"), "classes"
    )
    orders = classes.select("id", "n", "sketch").mapInArrow(_orders, f"tree int, label binary, id {id_type}, n bigint")
    sorted_orders = orders.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    members, candidates = _proposed(sorted_orders, percent, id_type, scratch)

    sketches = classes.select("id", "sketch")

    def estimated(pairs: DataFrame) -> DataFrame:
        one, two = (sketches.select(F.col("id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in ("a", "b"))
        sides = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b")
        return sides.mapInArrow(_estimates, f"a {id_type}, b {id_type}, share double")

    nodes = members.select("id").distinct().join(classes.select("id", "key"), "id")
    own = scratch.write(
        texts.join(nodes, "id").select("id", "text", "key").mapInArrow(_own_texts(width), f"id {id_type}, text string"),
        "texts",
    )

    blocks = F.lit(-(-own.count() // BLOCK) or 1)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough; a text goes once to each two blocks that need it."""
        x, y = (F.pmod(F.xxhash64(k), blocks) for k in ("a", "b"))
        placed = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "a", "b")
        ends = placed.select("x", "y", F.col("a").alias("id")).unionByName(placed.select("x", "y", F.col("b").alias("id")))
        wanted = ends.distinct().join(own, "id")
        wanted = wanted.select("x", "y", "id", F.lit(None).cast(id_type).alias("other"), "text")
        asked = placed.select("x", "y", F.col("a").alias("id"), F.col("b").alias("other"), F.lit(None).cast("string").alias("text"))
        met = wanted.unionByName(asked).repartition("x", "y").sortWithinPartitions("x", "y", F.col("other").asc_nulls_first())
        return met.mapInArrow(_confirmer(width, percent, arrow_id), f"a {id_type}, b {id_type}")

    scored = scratch.write(estimated(candidates), "scored")
    ends = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    best = Window.partitionBy("a").orderBy(F.desc("share"), "b")  # a document has two neighbours an order
    tried = scratch.write(
        ends.withColumn("place", F.row_number().over(best)).filter("place <= 2")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "tried",
    )
    links = scratch.write(confirmed(tried), "links")
    found = components(links, scratch, "first")

    more = scratch.write(_across(members, found, own, width, percent, scratch), "more")
    sides = [found.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in ("a", "b")]
    joins = more.join(sides[0], "a", "left").join(sides[1], "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")
    )
    wider = components(joins.distinct(), scratch, "second").select(F.col("node").alias("inner"), F.col("component").alias("outer"))
    by_key = (
        classes.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("key", F.coalesce("component", "id").alias("inner")).join(wider, "inner", "left")
        .select("key", F.coalesce("outer", "inner").alias("component"))
    )
    result = rows.select("id", "n", "key").join(by_key, "key", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
    return scratch.finish(result)


def _spread(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, id) of every set."""
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                sets, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
                rows = pa.array(np.repeat(np.arange(lo, hi), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), batch.column(0).take(rows)], ["shingle", "id"])

    return run


def _whole_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their sets, sorted, in place of the texts (the last column)."""
        for batch in batches:
            last = batch.num_columns - 1
            data, offsets = text_bytes(batch.column(last))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                sets, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
                raw = [sets[a:b].tobytes() for a, b in pairwise(bounds)]
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(last)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.binary())], [*batch.schema.names[:last], "shingles"])

    return run


def _salted(rows: DataFrame, aggregate: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join with one row per key, such that a key's rows are spread over ``SALTS`` tasks."""
    every = aggregate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(every, [*keys, "salt"]).drop("salt")


def _across(members: DataFrame, found: DataFrame, own: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between documents of different components of one family.

    A shingle that no other open document has is in no intersection. What is left of a set bounds its
    similarity to any other; documents that cannot reach the threshold with the smallest set of their
    region drop out.
    """
    region = ["tree", "prefix"]
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    apart = [F.min("component").alias("low"), F.max("component").alias("high")]
    several = placed.groupBy(*region).agg(*apart, F.min("n").alias("least")).filter("low <> high").select(*region, "least")
    placed = scratch.write(_salted(placed, several, region).select(*region, "id", "n", "component", "least"), "placed")
    kind = own.schema["id"].dataType.simpleString()
    open_texts = own.join(placed.select("id").distinct(), "id", "left_semi").select("id", "text")
    alone = open_texts.mapInArrow(_spread(width), f"shingle bigint, id {kind}").groupBy("shingle").agg(
        F.min("id").alias("id"), F.max("id").alias("last")
    ).filter("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    placed = placed.join(alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    least = F.greatest(F.col("least") * 100, F.col("n") * percent)  # in hundredths
    placed = placed.filter(F.col("common") * (100 + percent) * 100 >= (F.col("n") * 100 + least) * percent)
    placed = scratch.write(placed.select(*region, "id", "n", "component", "common"), "open")
    regions = placed.groupBy(*region).agg(*apart, F.min("id").alias("first")).filter("low <> high").select(*region, "first")
    linked = scratch.write(_salted(placed, regions, region).select("id", "n", "component", "common", "first").distinct(), "linked")
    families = components(linked.select(F.col("id").alias("a"), F.col("first").alias("b")), scratch, "families").select(
        F.col("node").alias("id"), F.col("component").alias("family")
    )
    docs = linked.select("id", "n", "component", "common").distinct().join(families, "id")
    docs = scratch.write(docs.select("family", "id", "n", "component", "common"), "families")
    sizes = docs.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    docs = _salted(docs, sizes, ["family"]).withColumn("mine", mine).join(own.select("id", "text"), "id")
    sets = docs.select("family", "blocks", "mine", "id", "n", "component", "common", "text").mapInArrow(
        _whole_sets(width), f"family {kind}, blocks int, mine int, id {kind}, n bigint, component {kind}, common bigint, shingles binary"
    )
    # Every two blocks of a family meet once.
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "id", "n", "component",
        "common", "shingles",
    )
    at = ["family", "x", "y"]
    met = met.repartition(*at).sortWithinPartitions(*at, "id")
    return met.mapInArrow(_meeting(percent), f"a {kind}, b {kind}")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal leading columns, one table per group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch) == 0:
            continue
        new = np.zeros(len(batch), bool)
        for k in range(keys):
            column = batch.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
        new[0] = not held or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys))
        bounds = [*np.flatnonzero(new).tolist(), len(batch)]
        if bounds[0] > 0:
            held.append(batch.slice(0, bounds[0]))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(lo, hi - lo)]
    if held:
        yield pa.Table.from_batches(held)


def common_shingles(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with those at ``columns``, by products of incidence matrices."""
    used = np.union1d(rows, columns)
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[k] for k in used.tolist()])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used.tolist()])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begins = np.flatnonzero(new)
    times = np.diff(np.append(begins, len(flat)))
    shared = np.repeat(times > 1, times)  # a shingle of one set is in no intersection
    owner, number = owner[shared], np.repeat(np.cumsum(times > 1) - 1, times)[shared]
    total = np.zeros((len(rows), len(columns)), np.float32)  # counts are exact up to 2^24
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(number, [lo, lo + COLUMNS])
        incidence = np.zeros((len(used), COLUMNS), np.float32)
        incidence[owner[a:b], number[a:b] - lo] = 1
        total += incidence[place[rows]] @ incidence[place[columns]].T
    return total.astype(np.int64)


def _meeting(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of two blocks: links between components that no link before in the same place has joined."""
        for table in _groups(batches, 3):
            table = table.combine_chunks()
            ids, component = (table.column(k).combine_chunks() for k in ("id", "component"))
            mine, n, common = (table.column(k).to_numpy() for k in ("mine", "n", "common"))
            x, y = (table.column(k)[0].as_py() for k in ("x", "y"))
            one, two = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
            group = component.dictionary_encode().indices.to_numpy()
            fit = (group[one, None] != group[two]) & _similar_sizes(n[one, None], n[two], percent)
            fit &= np.minimum(common[one, None], common[two]) * (100 + percent) >= (n[one, None] + n[two]) * percent
            if x == y:
                fit &= one[:, None] < two
            if not fit.any():
                continue
            rows, columns = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
            data, offsets = text_bytes(table.column("shingles"))
            sets = [np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in pairwise(offsets)]
            one, two, fit = one[rows], two[columns], fit[np.ix_(rows, columns)]
            fit &= common_shingles(sets, one, two) * (100 + percent) >= (n[one, None] + n[two]) * percent
            parent = list(range(int(group.max()) + 1))
            links = []
            for a, b in np.argwhere(fit).tolist():
                ends = [int(group[one[a]]), int(group[two[b]])]
                for k in (0, 1):
                    while parent[ends[k]] != ends[k]:
                        parent[ends[k]] = parent[parent[ends[k]]]
                        ends[k] = parent[ends[k]]
                if ends[0] != ends[1]:
                    parent[max(ends)] = min(ends)
                    links.append((int(one[a]), int(two[b])))
            if links:
                left, right = (ids.take(pa.array([link[k] for link in links])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([left, right], ["a", "b"])

    return run
