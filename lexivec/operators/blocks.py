"""Products of tables of vectors, block by block.

Both sides are rows of blocks: vectors are cut where they lie, without a shuffle, matrices are gathered by
block number. Blocks meet by an equi-join on their numbers. A side of checked size is broadcast; beyond that both
are dealt by block number and a salt, so that no number, of which there are few, is one task's work. No block of
either side passes through the driver, and the plan has the same size whatever the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexivec.functions.arrays import dense
from lexivec.scratch import Scratch

BLOCK_CELLS = 1 << 18  # numbers of a block, 2 MB of doubles
BROADCAST_CELLS = 1 << 22  # numbers of a side that goes to every task, 32 MB of doubles
BUNDLE = 8  # blocks of a matrix that a join task holds for one block of vectors
HELD = 1 << 18  # leading rows that a task keeps before it hands them on
SLACK = 1 + 1e-9  # for rounding in a bound


def _number(table: DataFrame, vec: str) -> str:
    element = table.schema[vec].dataType.elementType
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def _cutter(cols: int | None, side: int | None, cells: int, number: str, other: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a task's rows; within a batch the longest vectors come first."""
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            x, missing = dense(batch.column(1))
            if not x.size:
                continue
            width = x.shape[1]
            if cols is not None and width != cols:
                raise ValueError(f"a vector of {width} elements meets a matrix of {cols} columns")
            x = x.astype(number)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
            order = np.argsort(-np.nan_to_num(norm, nan=np.inf), kind="stable")
            ids, x, norm = batch.column(0).filter(pa.array(~missing)).take(pa.array(order)), x[order], norm[order]
            step = max(1, cells // max(min(width, side or width), other))
            for lo in range(0, len(x), step):
                rows = x[lo : lo + step]
                for part, left in enumerate(range(0, width, side or width)):
                    piece = np.ascontiguousarray(rows[:, left : left + (side or width)])
                    keys = ids.slice(lo, len(rows) if part == 0 else 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at], pa.int64()), pa.array([part], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([len(rows)], pa.int32()),
                         pa.array([np.nan_to_num(norm[lo], nan=np.inf)]), pa.array([piece.tobytes()], pa.binary())],
                        ["block", "part", "keys", "n", "norm", "x"],
                    )
                at += 1

    return run


def vector_blocks(
    table: DataFrame, key: str, vec: str, cols: int | None = None, side: int | None = None, cells: int = BLOCK_CELLS, other: int = 1
) -> DataFrame:
    """(block, part, keys, n, norm, x): blocks of the vectors, cut into parts of ``side`` columns.

    The first part has the keys; ``norm`` is the largest of the block. NULL vectors are left out, a NULL
    element is NaN. ``cols`` is the expected length, ``other`` bounds the rows of a block by what they meet.
    """
    kind = table.schema[key].dataType.simpleString()
    return table.select(key, vec).mapInArrow(
        _cutter(cols, side, cells, _number(table, vec), other), f"block bigint, part int, keys array<{kind}>, n int, norm double, x binary"
    )


def _dense_blocks(rows: int, cols: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                bi, bj, cells = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                matrix = np.zeros((min(side, rows - bi * side), min(side, cols - bj * side)))
                i, j, v = (cells.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                np.add.at(matrix, (i, j), v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(matrix)], pa.int32()),
                     pa.array([matrix.tobytes()], pa.binary())],
                    ["bi", "bj", "h", "w"],
                )

    return run


def matrix_blocks(cells: DataFrame, rows: int, cols: int, side: int) -> DataFrame:
    """(bi, bj, h, w): the blocks of a ``(row, col, val)`` matrix; absent cells are 0, repeated ones add up."""
    down, across = -(-rows // side), -(-cols // side)
    corner = F.col("id")  # every block has a cell
    corners = cells.sparkSession.range(down * across).select(
        (F.floor(corner / across) * side).alias("row"), (corner % across * side).alias("col"), F.lit(0.0).alias("val")
    )
    known = cells.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), F.col("val").cast("double")).unionByName(corners)
    number = [F.floor(F.col(c) / side).cast("int").alias(b) for c, b in (("row", "bi"), ("col", "bj"))]
    inner = F.struct((F.col("row") % side).cast("int").alias("i"), (F.col("col") % side).cast("int").alias("j"), "val")
    gathered = known.groupBy(*number).agg(F.collect_list(inner).alias("cells"))  # at most a block
    return gathered.mapInArrow(_dense_blocks(rows, cols, side), "bi int, bj int, h int, w binary")


def meet(x: DataFrame, other: DataFrame, keys: list[Column], bundle: Column, bundles: int, numbers: int, small: bool) -> DataFrame:
    """Blocks of vectors with the blocks of the other side that have their keys, bundle by bundle.

    ``keys`` are those of the vectors; ``other`` has equal ones in columns ``k0``, ``k1`` ... ``numbers`` is how many
    different ones there are, and decides on the salt.
    """
    spread = x.select("*", *[k.alias(f"k{n}") for n, k in enumerate(keys)], F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"))
    other = other.withColumn("bundle", bundle)
    on = [*(f"k{n}" for n in range(len(keys))), "bundle"]
    if small:
        return spread.join(F.broadcast(other), on)
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-tasks // (numbers * bundles)))
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(other, [*on, "salt"])


def _long_rows(keys: pa.Array, first: int, product: np.ndarray, key: str) -> pa.RecordBatch:
    n, h = product.shape
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(np.repeat(np.arange(n), h))), pa.array(np.tile(np.arange(first, first + h, dtype=np.int32), n)),
         pa.array(product.ravel())],
        [key, "row", "val"],
    )


def _multiply(number: str, side: int, key: str, partial: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "part", "keys", "n", "x", "bi", "h", "w"]
        for batch in batches:
            for k in range(len(batch)):
                block, part, keys, n, x, bi, h, w = (batch.column(c)[k] for c in range(len(names)))
                n, h = n.as_py(), h.as_py()
                rows = np.frombuffer(x.as_buffer(), number).reshape(n, -1).astype(np.float64)
                product = rows @ np.frombuffer(w.as_buffer(), "<f8").reshape(h, -1).T
                if not partial:
                    yield _long_rows(keys.values, bi.as_py() * side, product, key)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(k, 1) for c in (0, 5, 1, 2, 3, 6)), pa.array([product.tobytes()], pa.binary())],
                    ["block", "bi", "part", "keys", "n", "h", "p"],
                )

    return run


def _add_up(side: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted partial products of a block and matrix row, the part with the keys first, added up."""
        at, keys, total, first = None, None, None, 0
        for batch in batches:
            for k in range(len(batch)):
                here = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                n, h = batch.column(4)[k].as_py(), batch.column(5)[k].as_py()
                product = np.frombuffer(batch.column(6)[k].as_buffer(), "<f8").reshape(n, h)
                if here != at:
                    if at is not None:
                        yield _long_rows(keys, first, total, key)
                    at, keys, total, first = here, batch.column(3)[k].values, product.copy(), here[1] * side
                else:
                    total += product
        if at is not None:
            yield _long_rows(keys, first, total, key)

    return run


def block_product(
    table: DataFrame, cells: DataFrame, rows: int, cols: int, key: str, vec: str, block_cells: int = BLOCK_CELLS,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """``(key, row, val)``: a ``(row, col, val)`` matrix of the given shape times every vector.

    One column of blocks: products leave the join as they are. Several: partial products are added up
    by block and matrix rows, where the vectors' blocks are stored first, so that a repeated task cuts none anew.
    """
    side = max(1, isqrt(block_cells))
    down, across = -(-rows // side), -(-cols // side)
    x = vector_blocks(table, key, vec, cols, side, block_cells, min(rows, side))
    if across > 1:
        x = Scratch(table.sparkSession, "product").write(x, "vectors")
    w = matrix_blocks(cells, rows, cols, side).withColumnRenamed("bj", "k0")
    bundle = F.floor(F.col("bi") / BUNDLE).cast("int")
    met = meet(x, w, [F.col("part")], bundle, -(-down // BUNDLE), across, rows * cols <= broadcast_cells)
    met = met.select("block", "part", "keys", "n", "x", "bi", "h", "w")
    kind = table.schema[key].dataType.simpleString()
    out, number = f"{key} {kind}, row int, val double", _number(table, vec)
    if across == 1:
        return met.mapInArrow(_multiply(number, side, key, False), out)
    parts = met.mapInArrow(
        _multiply(number, side, key, True), f"block bigint, bi int, part int, keys array<{kind}>, n int, h int, p binary"
    )
    return parts.repartition("block", "bi").sortWithinPartitions("block", "bi", "part").mapInArrow(_add_up(side, key), out)


class _Leaders:
    """The best ``k`` rows of each query of a block, smaller keys first on ties."""

    def __init__(self, names: pa.Array, queries: np.ndarray, k: int, key: str):
        # Copies: a slice would keep the whole Arrow batch that it came in.
        self.names, self.queries, self.k, self.key = names.take(pa.array(np.arange(len(names)))), queries.copy(), k, key
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.best: list[pa.Table | None] = [None] * len(names)
        self.mark = np.full(len(names), -np.inf)  # score of the k-th row, once there are k
        self.rows = 0

    def meet(self, ids: pa.Array, x: np.ndarray, norm: float) -> int:
        """Take in a block of vectors; returns how many queries could not gain from it, by its largest norm."""
        with np.errstate(invalid="ignore", over="ignore"):
            wanted = np.flatnonzero(~(norm * self.norms * SLACK < self.mark))
            scores = x @ self.queries[wanted].T if len(wanted) else np.zeros((len(x), 0))
            peak = np.fmax.reduce(scores, axis=0)
            gains = np.flatnonzero(peak >= self.mark[wanted])  # a NaN score is no result
        for at in gains.tolist():
            n, column = int(wanted[at]), scores[:, at]
            rows = np.flatnonzero(column >= self.mark[n])
            if len(rows) > self.k:
                least = np.partition(column[rows], len(rows) - self.k)[len(rows) - self.k]
                rows = rows[column[rows] >= least]
            new = pa.table({self.key: ids.take(pa.array(rows)), "score": column[rows]})
            held = self.best[n]
            new = new if held is None else pa.concat_tables([held, new])
            new = new.take(pc.sort_indices(new, [("score", "descending"), (self.key, "ascending")])[: self.k])
            self.rows += len(new) - (0 if held is None else len(held))
            self.best[n] = new
            if len(new) == self.k:
                self.mark[n] = new.column("score")[self.k - 1].as_py()
        return len(self.mark) - len(wanted)

    def batches(self, query: str) -> Iterator[pa.RecordBatch]:
        found = [(n, best) for n, best in enumerate(self.best) if best is not None]
        if found:
            names = self.names.take(pa.array(np.repeat([n for n, _ in found], [len(best) for _, best in found])))
            rows = pa.concat_tables([best for _, best in found]).combine_chunks()
            none = pa.nulls(len(names), pa.int64())
            columns = [names, *(c.combine_chunks() for c in rows.columns), none, none]
            yield pa.RecordBatch.from_arrays(columns, [query, self.key, "score", "met", "skipped"])


def _counted(met: int, skipped: int, key: str, query: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.float64()), pa.array([met]), pa.array([skipped])],
        [query, key, "score", "met", "skipped"],
    )


def _scorer(number: str, k: int, key: str, query: str, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Leaders] = {}
        met = skipped = 0
        for batch in batches:
            for row in range(len(batch)):
                keys, n, norm, x, block, names, m, q = (batch.column(c)[row] for c in range(8))
                x = np.frombuffer(x.as_buffer(), number).reshape(n.as_py(), -1).astype(np.float64)
                leaders = held.get(block.as_py())
                if leaders is None:
                    wanted = np.frombuffer(q.as_buffer(), "<f8").reshape(m.as_py(), -1)
                    leaders = held[block.as_py()] = _Leaders(names.values, wanted, k, key)
                if x.shape[1] != leaders.queries.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} elements meet queries of {leaders.queries.shape[1]}")
                skipped += leaders.meet(keys.values, x, norm.as_py())
                met += len(leaders.mark)
            if sum(one.rows + one.queries.size // max(1, k) for one in held.values()) > HELD:
                for one in held.values():
                    yield from one.batches(query)
                held = {}
        for one in held.values():
            yield from one.batches(query)
        if met:
            yield _counted(met, skipped, key, query, kinds)

    return run


def _deal(x: DataFrame, q: DataFrame, bundles: int) -> DataFrame:
    """A bundle of query blocks in one place per salt, and behind it the vectors' blocks of that salt, longest first."""
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-tasks // bundles))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = {c: F.lit(None).cast(d.schema[c].dataType).alias(c) for d, c in ((x, "keys"), (q, "names"))}
    asked = q.select(
        share("asked", bundles).alias("bundle"), number(salts).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("norm"),
        F.col("asked").alias("block"), none["keys"], "names", F.col("m").alias("n"), F.col("q").alias("x"),
    )
    rows = x.select(
        number(bundles).alias("bundle"), share("block", salts).alias("salt"), F.lit(1).alias("kind"), "norm", "block", "keys", none["names"], "n", "x"
    )
    place = ["bundle", "salt"]
    return asked.unionByName(rows).repartition(*place).sortWithinPartitions(*place, "kind", F.desc("norm"), "block")


def _dealt_scorer(number: str, k: int, key: str, query: str, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of ``_deal``: the leaders of one place at a time, which take in small blocks of vectors together."""
        here, held, ids, rows, longest = None, [], [], [], 0.0
        met = skipped = 0

        def take_in() -> None:
            nonlocal met, skipped, longest
            if rows:
                whole = np.concatenate(rows)
                for leaders in held:
                    if whole.shape[1] != leaders.queries.shape[1]:
                        raise ValueError(f"vectors of {whole.shape[1]} elements meet queries of {leaders.queries.shape[1]}")
                    skipped += leaders.meet(pa.concat_arrays(ids), whole, longest)
                    met += len(leaders.mark)
            ids.clear(), rows.clear()
            longest = 0.0

        for batch in batches:
            for row in range(len(batch)):
                bundle, salt, kind, norm, _, keys, names, n, x = (batch.column(c)[row] for c in range(9))
                now = (bundle.as_py(), salt.as_py())
                if now != here:
                    take_in()
                    for leaders in held:
                        yield from leaders.batches(query)
                    here, held = now, []
                if kind.as_py() == 0:
                    held.append(_Leaders(names.values, np.frombuffer(x.as_buffer(), "<f8").reshape(n.as_py(), -1), k, key))
                elif held:
                    block = np.frombuffer(x.as_buffer(), number).reshape(n.as_py(), -1).astype(np.float64)
                    if rows and (rows[0].shape[1] != block.shape[1] or sum(r.size for r in rows) + block.size > BLOCK_CELLS):
                        take_in()
                    ids.append(keys.values)
                    rows.append(block)
                    longest = max(longest, norm.as_py())
        take_in()
        for leaders in held:
            yield from leaders.batches(query)
        if met:
            yield _counted(met, skipped, key, query, kinds)

    return run


def block_scores(
    table: DataFrame, queries: DataFrame, key: str, vec: str, query: str, wanted: str, k: int, cells: int, total: int,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """``(query, key, score, met, skipped)``: per task the best ``k`` rows of each query, and a last row of counts.

    ``wanted`` is the vector column of ``queries``, which hold ``total`` numbers. Every block of vectors meets every
    block of queries: at most ``broadcast_cells`` numbers go to every task, more of them are dealt in bundles, of which a
    task holds one, and every block of vectors goes once to each bundle. Vectors come longest first, and a query skips a block whose largest norm times its own
    cannot reach the score of its k-th row: ``met`` and ``skipped`` count these meetings of a query and a block.
    """
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, query), (table, key))]
    arrow = [to_arrow_type(d.schema[c].dataType) for d, c in ((queries, query), (table, key))]
    x = vector_blocks(table, key, vec, cells=cells)
    asked = queries.select(query, F.col(wanted).cast("array<double>").alias(wanted))
    q = vector_blocks(asked, query, wanted, cells=cells).select(
        F.col("block").alias("asked"), F.col("keys").alias("names"), F.col("n").alias("m"), F.col("x").alias("q")
    )
    out = f"{query} {kinds[0]}, {key} {kinds[1]}, score double, met bigint, skipped bigint"
    number = _number(table, vec)
    if total > broadcast_cells:
        bundles = -(-total // max(cells * BUNDLE, BLOCK_CELLS))
        return _deal(x, q, bundles).mapInArrow(_dealt_scorer(number, k, key, query, arrow), out)
    met = meet(x, q, [], F.lit(0), 1, 1, True).select("keys", "n", "norm", "x", "asked", "names", "m", "q")
    return met.mapInArrow(_scorer(number, k, key, query, arrow), out)
