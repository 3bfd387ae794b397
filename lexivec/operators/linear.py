"""Vector and matrix operators over tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors as vx
from lexivec.functions.arrays import dense, ragged, rowwise
from lexivec.operators import blocks
from lexivec.operators.ordering import global_rank
from lexivec.scratch import Scratch

MODEL_CELLS = 4_000_000  # the largest matrix that a task holds whole


def shape_check(table: DataFrame, vec: str, width: int) -> DataFrame:
    """Rows per vector length and whether the length is the expected one; NULL vectors have none."""
    return (
        table.groupBy(F.when(F.col(vec).isNotNull(), F.size(vec)).alias("width"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("matches", F.coalesce(F.col("width") == width, F.lit(False)))
    )


def row_view(table: DataFrame, wanted: DataFrame, key: str, vec: str, start: int, length: int) -> DataFrame:
    """A slice of the wanted rows; ``start`` counts from 0."""
    rows = table.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.select(key, F.slice(vec, start + 1, length).alias(vec))


def fill_like(table: DataFrame, key: str, vec: str, value: float) -> DataFrame:
    """A constant matrix with the shape of the table."""
    return table.select(key, F.array_repeat(F.lit(value), F.size(vec)).alias(vec))


def matrix_shape(cells: DataFrame) -> tuple[int, int]:
    """Rows and columns of a ``(row, col, val)`` matrix; a row without cells counts."""
    top = cells.agg(F.max("row"), F.max("col")).first()
    if top[0] is None:
        raise ValueError("the matrix has no cells")
    return int(top[0]) + 1, int(top[1]) + 1


def small_matrix(cells: DataFrame) -> np.ndarray:
    """A ``(row, col, val)`` matrix as an array; fails when it exceeds the size that a task may hold."""
    rows, cols = matrix_shape(cells)
    if rows * cols > MODEL_CELLS:
        raise ValueError(f"a matrix of {rows} x {cols} exceeds {MODEL_CELLS} cells; take products in blocks (matmul)")
    found = cells.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), F.col("val").cast("double")).toArrow()
    matrix = np.zeros((rows, cols))
    at = [found.column(k).to_numpy() for k in range(3)]
    matrix[at[0], at[1]] = at[2]
    return matrix


def matmul(
    table: DataFrame, cells: DataFrame, key: str, vec: str, block_cells: int = blocks.BLOCK_CELLS,
    broadcast_cells: int = blocks.BROADCAST_CELLS,
) -> DataFrame:
    """Product of a ``(row, col, val)`` matrix with every vector, in long form ``(key, row, val)``.

    Both sides are cut into blocks of about ``block_cells`` numbers, which meet in Spark by block number: a
    matrix of at most ``broadcast_cells`` goes to every task and the vectors are never shuffled, a larger one is
    dealt over the tasks, and so are the vectors' blocks. A row without cells gives 0, a NULL vector no rows, a
    NULL element NaN; a vector whose length is not the number of columns fails.
    """
    return blocks.block_product(table, cells, *matrix_shape(cells), key, vec, block_cells, broadcast_cells)


def matmul_by_join(
    table: DataFrame, cells: DataFrame, key: str, vec: str, broadcast_cells: int = blocks.BROADCAST_CELLS
) -> DataFrame:
    """The product with a sparse matrix in long form: equi-join on the column, partial sums before the shuffle.

    Only rows with cells appear, and an absent cell has no part in a sum, also where the element is not
    finite. A vector whose length is not the number of columns fails, a NULL element counts as NaN. Every vector has every
    column, so beyond ``broadcast_cells`` cells the columns are salted by the key and the cells repeated per salt.
    """
    top = cells.agg(F.max("col"), F.count(F.lit(1))).first()
    if top[0] is None:
        raise ValueError("the matrix has no cells")
    cols = int(top[0]) + 1
    checked = F.when(F.size(vec) == cols, F.col(vec)).when(
        F.col(vec).isNotNull(), F.raise_error(F.lit(f"a vector does not have {cols} elements"))
    )
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = 1 if top[1] <= broadcast_cells else max(1, -(-tasks // cols))
    x = table.select(key, F.pmod(F.xxhash64(key), F.lit(salts)).alias("salt"), F.posexplode(checked).alias("col", "x"))
    sparse = cells.select("row", "col", "val", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    sparse = F.broadcast(sparse) if top[1] <= broadcast_cells else sparse
    products = x.join(sparse, ["col", "salt"]).select(
        key, F.col("row").cast("int").alias("row"), (F.coalesce(F.col("x").cast("double"), F.lit(float("nan"))) * F.col("val")).alias("p")
    )
    return products.groupBy(key, "row").agg(F.sum("p").alias("val"))


def residual_add(a: DataFrame, b: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise sum of two vector tables on their key."""
    other = b.select(key, F.col(vec).alias("_other"))
    return a.join(other, key).select(key, vx.residual_add(F.col(vec), F.col("_other")).alias(vec))


STEP = 256.0  # values of one step share a power, so no power leaves the range of a double


def softmax_by_group(table: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Softmax over all rows of a group, NULL being a group like any other.

    One aggregation sums the powers per group and step of ``STEP`` values, combined map-side; the
    few sums of a group are put together at its highest step and looked up per row. Two scans, and no
    task receives a whole group. A NULL value has no power.
    """
    x = F.col(value).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    step = F.when(finite, F.floor(x / STEP)).otherwise(F.when(x.isNotNull(), F.lit(0)))
    sums = table.groupBy(F.col(group).alias("_group"), step.alias("_step")).agg(F.sum(F.exp(x - step * STEP)).alias("_sum"))
    whole = sums.filter("_step is not null").groupBy("_group").agg(F.max("_step").alias("_top"), F.collect_list(F.struct("_step", "_sum")).alias("_sums"))
    total = F.aggregate("_sums", F.lit(0.0), lambda s, p: s + p["_sum"] * F.exp((p["_step"] - F.col("_top")) * STEP))
    whole = whole.select("_group", "_top", total.alias("_total"))
    rows = table.select(group, key, value)
    placed = rows.join(whole, rows[group].eqNullSafe(whole["_group"]), "left")
    return placed.select(group, key, (F.exp(x - F.col("_top") * STEP) / F.col("_total")).alias("p"))


def top_k(table: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """The ``k`` largest elements of every vector with their index; ``k = 1`` is the argmax."""
    ranked = table.select(key, F.posexplode(vx.top_k(F.col(vec), k)).alias("r", "e"))
    return ranked.select(key, (F.col("r") + 1).alias("rank"), "e.idx", "e.val")


def activation_profile(table: DataFrame, by: str, vec: str, curves: dict[str, Column]) -> DataFrame:
    """Smallest, largest and mean value of each curve per group; curves are expressions of ``x``."""
    cells = table.select(by, F.explode(vec).alias("x")).select(by, F.col("x").cast("double").alias("x"))
    measures = []
    for name, curve in curves.items():
        measures += [
            F.min(curve).alias(f"{name}_min"),
            F.max(curve).alias(f"{name}_max"),
            F.avg(curve).alias(f"{name}_avg"),
        ]
    return cells.groupBy(by).agg(*measures)


def swiglu(a: DataFrame, g: DataFrame, key: str, vec: str, beta: float) -> DataFrame:
    """``swish(a) * g`` of two vector tables and both partial derivatives, per element."""
    both = a.select(key, F.col(vec).alias("a")).join(g.select(key, F.col(vec).alias("g")), key)
    both = both.withColumn("g", vx.same_size(F.col("a"), F.col("g"), F.col("g")))
    cells = both.select(key, F.posexplode(F.arrays_zip("a", "g")).alias("j", "e")).select(
        key, "j", F.col("e.a").cast("double").alias("a"), F.col("e.g").cast("double").alias("g")
    )
    return cells.select(
        key,
        "j",
        (vx.swish(F.col("a"), beta) * F.col("g")).alias("y"),
        (vx.swish_prime(F.col("a"), beta) * F.col("g")).alias("da"),
        vx.swish(F.col("a"), beta).alias("dg"),
    )


def sequence_positions(table: DataFrame, group: str, order: str, scratch: Scratch | None = None) -> DataFrame:
    """Place every row in the sequence of its group: ``pos`` from 0, whatever the length."""
    return global_rank(table, [order], [group], into="_rank", scratch=scratch).withColumn("pos", F.col("_rank") - 1).drop("_rank")


def _turn(x: np.ndarray, pos: np.ndarray, base: float) -> np.ndarray:
    """Rotary positions for an array ``(row, head, head_dim)``."""
    head_dim = x.shape[2]
    half = head_dim // 2
    angle = pos[:, None, None] * base ** (-np.arange(half) / head_dim)
    first, second = x[:, :, :half], x[:, :, half:]
    return np.concatenate(
        [first * np.cos(angle) - second * np.sin(angle), first * np.sin(angle) + second * np.cos(angle)],
        axis=2,
    )


ATTENTION_BLOCK = 256  # positions of a block, and of the keys that are taken in together
ATTENTION_POSITIONS = 2048  # positions of queries in one place


class _Queries:
    """The query positions of a group with their running softmax over stretches of keys."""

    def __init__(self, blocks_of: list[pa.Array], heads: int, share: int, base: float):
        self.heads, self.share, self.base = heads, share, base
        parts = [_block_parts(rows, ("q",)) for rows in blocks_of]
        self.keys = pa.concat_arrays([keys.take(pa.array(np.arange(len(keys)))) for keys, _, _ in parts])
        self.pos = np.concatenate([pos for _, pos, _ in parts])
        q = np.concatenate([q for _, _, (q,) in parts])
        q = _turn(q.reshape(len(q), heads, -1), self.pos, base)
        self.q = self._rows(q / np.sqrt(q.shape[2]))
        self.peak = np.full((*self.q.shape[:2], 1), -np.inf)
        self.sum = np.zeros(self.peak.shape)
        self.out: np.ndarray | None = None

    def _rows(self, x: np.ndarray) -> np.ndarray:
        """``(row, head, d)`` as ``(key head, share of it and row, d)``."""
        return np.ascontiguousarray(x.reshape(len(x), -1, self.share, x.shape[2]).transpose(1, 2, 0, 3)).reshape(self.heads // self.share, -1, x.shape[2])

    def meet(self, pos: np.ndarray, k: np.ndarray, v: np.ndarray) -> None:
        """Take in a stretch of keys and values."""
        k = _turn(k.reshape(len(k), self.heads // self.share, -1), pos, self.base).transpose(1, 2, 0)
        v = v.reshape(len(v), self.heads // self.share, -1).transpose(1, 0, 2)
        with np.errstate(invalid="ignore", over="ignore"):
            scores = self.q @ k
            seen = None if pos.max() <= self.pos.min() else np.tile(pos[None, :] <= self.pos[:, None], (self.share, 1))
            if seen is not None:
                scores = np.where(seen, scores, -np.inf)
            peak = np.maximum(self.peak, scores.max(axis=2, keepdims=True))
            level = np.where(np.isneginf(peak), 0.0, peak)
            keep = np.exp(self.peak - level)
            power = np.exp(np.subtract(scores, level, out=scores), out=scores)
            odd = np.flatnonzero(~np.isfinite(v).all(axis=(0, 2)))  # 0 times these is no 0 for a position before them
            gain = power @ (v if not len(odd) else np.where(np.isfinite(v).all(axis=(0, 2))[None, :, None], v, 0.0))
            for at in odd.tolist():
                own = power[:, :, at, None] * v[:, at, None, :]
                gain = gain + (own if seen is None else np.where(seen[:, at][None, :, None], own, 0.0))
            self.sum = self.sum * keep + power.sum(axis=2, keepdims=True)
            self.out = gain if self.out is None else self.out * keep + gain
        self.peak = peak

    def rows(self, key: str) -> pa.RecordBatch:
        out = (self.out / self.sum).reshape(self.heads // self.share, self.share, len(self.pos), -1)
        out = out.transpose(2, 0, 1, 3).reshape(len(self.pos), -1)
        return pa.RecordBatch.from_arrays([self.keys, ragged(out, np.zeros(len(out), bool), pa.float64())], [key, "out"])


def _block_parts(rows: pa.Array, names: tuple[str, ...]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Keys, positions and matrices of a block, a list of structs."""
    pos = rows.field("pos").to_numpy().astype(np.float64)
    return rows.field("key"), pos, [dense(rows.field(n))[0].astype(np.float64) for n in names]


def causal_attention(
    table: DataFrame, sequence: list[str], key: str, heads: int, kv_heads: int, base: float = vx.ROTARY_BASE,
    block: int = ATTENTION_BLOCK, group: int | None = None,
) -> DataFrame:
    """Grouped causal attention within each sequence: ``(key, out)``.

    ``table`` has the sequence columns, ``pos`` from 0, the key and vectors ``q``, ``k``, ``v``. A sequence
    of any length is cut into blocks of ``block`` positions, and ``group`` blocks of queries (those of ``ATTENTION_POSITIONS``)
    go to one place, where every block of keys not after them arrives once, sorted. A running maximum, sum and weighted sum
    per position and head are all that stays, so a task holds the queries of a group and a stretch of keys. The work is quadratic in
    the length, as attention is; what is shuffled is the queries once and the keys once per later group.
    """
    group = group or max(1, ATTENTION_POSITIONS // block)
    part = F.floor(F.col("pos") / block).cast("bigint")
    items = table.select(*sequence, part.alias("_block"), F.struct("pos", F.col(key).alias("key"), "q", "k", "v").alias("r"))
    rows = items.groupBy(*sequence, "_block").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    last = F.max("_block").over(Window.partitionBy(*sequence))  # one row per block, not per position
    names = [f"s{n}" for n in range(len(sequence))]
    at = [F.col(c).alias(n) for c, n in zip(sequence, names)]
    none = {c: F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("q", "k", "v")}
    queries = rows.select(
        *at, F.floor(F.col("_block") / group).alias("_group"), F.lit(0).alias("_kind"), "_block",
        F.transform("rows", lambda r: F.struct(r.pos, r.key, r.q, none["k"], none["v"])).alias("rows"),
    )
    keys = rows.withColumn("_last", last).select(
        *at, F.explode(F.sequence(F.floor(F.col("_block") / group), F.floor(F.col("_last") / group))).alias("_group"),
        F.lit(1).alias("_kind"), "_block", F.transform("rows", lambda r: F.struct(r.pos, r.key, none["q"], r.k, r.v)).alias("rows"),
    )
    kind = table.schema[key].dataType.simpleString()
    place = [*names, "_group"]
    met = queries.unionByName(keys).repartition(*place).sortWithinPartitions(*place, "_kind", "_block")

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, held, near = None, [], None, []

        def take_in() -> None:
            if near:
                held.meet(np.concatenate([p for p, _, _ in near]), np.concatenate([k for _, k, _ in near]), np.concatenate([v for _, _, v in near]))
                near.clear()

        for batch in batches:
            for n in range(len(batch)):
                *now, is_keys = (batch.column(c)[n].as_py() for c in range(len(place) + 1))
                if now != here:
                    take_in()
                    if held is not None:
                        yield held.rows(key)
                    here, asked, held = now, [], None
                values = batch.column(len(place) + 2)[n].values
                if not is_keys:
                    asked.append(values)
                    continue
                if held is None:
                    held, asked = _Queries(asked, heads, heads // kv_heads, base), []
                _, pos, (k, v) = _block_parts(values, ("k", "v"))
                near.append((pos, k, v))
                if sum(len(p) for p, _, _ in near) >= ATTENTION_BLOCK:
                    take_in()
        take_in()
        if held is not None:
            yield held.rows(key)

    return met.mapInArrow(attend, f"{key} {kind}, out array<double>")


def gated_ffn(
    table: DataFrame, key: str, vec: str, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, epsilon: float = vx.RMS_EPSILON
) -> DataFrame:
    """``x + W2 ((W1 n) * silu(W3 n))`` with ``n`` the normalised row."""

    def block(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        n = x / np.sqrt((x * x).mean(axis=1, keepdims=True) + epsilon)
        gate = n @ w3.T
        return x + ((n @ w1.T) * (gate / (1.0 + np.exp(-gate)))) @ w2.T

    return table.select(key, rowwise(block)(F.col(vec)).alias(vec))


def _scored(
    table: DataFrame, queries: DataFrame, key: str, vec: str, query: str, k: int, block_cells: int, broadcast_cells: int
) -> DataFrame:
    normal = queries.filter(F.col(vec).isNotNull()).select(
        query, vx.rmsnorm(F.col(vec), F.transform(vec, lambda _: F.lit(1.0))).alias("_q")
    )
    total = normal.agg(F.coalesce(F.sum(F.size("_q")), F.lit(0))).first()[0]
    return blocks.block_scores(table, normal, key, vec, query, "_q", k, block_cells, total, broadcast_cells)


def tied_scoring(
    table: DataFrame, queries: DataFrame, key: str, vec: str, query: str, k: int, block_cells: int = blocks.BLOCK_CELLS,
    broadcast_cells: int = blocks.BROADCAST_CELLS,
) -> DataFrame:
    """The ``k`` rows with the largest inner product for each normalised query vector.

    Vectors and queries are cut into blocks of about ``block_cells`` numbers that meet in Spark. Every task keeps its
    own ``k`` best rows per query, and only those are shuffled; queries of at most ``broadcast_cells`` numbers go to
    every task and the table stays where it is, more of them are dealt over the tasks with the table's blocks.
    Keys and queries may have any type; ties go to the smaller key. NULL vectors and NaN scores are left out.
    """
    best = _scored(table, queries, key, vec, query, k, block_cells, broadcast_cells).filter("met is null")
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    ranked = best.select(query, key, "score", F.row_number().over(order).alias("rank"))
    return ranked.filter(F.col("rank") <= k)


def scoring_skips(
    table: DataFrame, queries: DataFrame, key: str, vec: str, query: str, k: int, block_cells: int = blocks.BLOCK_CELLS
) -> DataFrame:
    """One row ``(met, skipped)``: meetings of a query and a block of vectors, and those that its norm bound ruled out."""
    counts = _scored(table, queries, key, vec, query, k, block_cells, blocks.BROADCAST_CELLS)
    zero = F.lit(0).cast("bigint")
    return counts.agg(F.coalesce(F.sum("met"), zero).alias("met"), F.coalesce(F.sum("skipped"), zero).alias("skipped"))


def table_reconcile(a: DataFrame, b: DataFrame, key: str, value: str, significand: int, single: bool = False) -> DataFrame:
    """Compare two keyed tables: rows per outcome (close, differs, left_only, right_only)."""
    left = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, key, "full")
    outcome = (
        F.when(F.col("_in_b").isNull(), "left_only")
        .when(F.col("_in_a").isNull(), "right_only")
        .when(vx.close(F.col("_a"), F.col("_b"), significand, single), "close")
        .otherwise("differs")
    )
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def clamp_report(table: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: range before, how many values a clamp changes, range and sum after."""
    measures, parts = [], []
    for name, (a, b) in bounds.items():
        x = F.col(name).cast("double")
        y = vx.clamp_between(x, F.lit(float(a)), F.lit(float(b)))
        measures += [
            F.min(x).alias(f"{name}_0"), F.max(x).alias(f"{name}_1"), F.count_if(x != y).alias(f"{name}_2"),
            F.min(y).alias(f"{name}_3"), F.max(y).alias(f"{name}_4"), F.sum(y).alias(f"{name}_5"),
        ]
        fields = ["min_before", "max_before", "n_changed", "min_after", "max_after", "sum_after"]
        middle = vx.midpoint(F.lit(float(a)), F.lit(float(b)))
        parts.append(
            F.struct(
                F.lit(name).alias("column"),
                *[F.col(f"{name}_{i}").alias(f) for i, f in enumerate(fields)],
                middle.alias("midpoint"),
            )
        )
    return table.agg(*measures).select(F.inline(F.array(*parts)))
