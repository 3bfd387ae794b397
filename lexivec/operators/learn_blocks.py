"""Training of a softmax classifier whose model is a table.

``learn.train_classifier`` holds the model on the driver. Here weights and velocity are rows of blocks, like the
vectors: an epoch joins them by block number, and the driver sees two numbers, the sums of the losses. Every epoch is a
saved version of the model, so training that was stopped goes on from the last one, and a lost executor costs its
tasks of one epoch.

An epoch, for blocks of vectors X and blocks W of the model (matrix rows down, columns across):
scores X W' by block and matrix rows, added up over the columns; the largest score and the sum of powers of each
vector, from the partial ones of every block of classes; the differences of probabilities and targets; their products with
X, added up in the tasks and then by block of the model; the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import vectors as vx
from lexivec.operators import blocks
from lexivec.operators.linear import matrix_shape
from lexivec.scratch import Scratch
from lexivec.sources import tables

HELD = 8  # blocks of the gradient that a task adds up before it hands them on
_SCORES = "block bigint, bi int, labels array<bigint>, n int, h int, p binary"


def _array(scalar: pa.Scalar, *shape: int) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), "<f8").reshape(shape)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(matrix, np.float64).tobytes()], pa.binary())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Scalar]]]:
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1), [column[k] for column in batch.columns]


def _partial_scores(number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, (_, _, _, _, n, h, x, w) in _rows(batches):
            n, h = n.as_py(), h.as_py()
            rows = np.frombuffer(x.as_buffer(), number).reshape(n, -1).astype(np.float64)
            product = rows @ np.frombuffer(w.as_buffer(), "<f8").reshape(h, -1).T
            yield pa.RecordBatch.from_arrays([*row.columns[:6], _binary(product)], ["block", "bi", "part", "labels", "n", "h", "p"])

    return run


def _add_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial scores of a block and rows of the model, the part with the labels first, added up."""
    at, first, total = None, None, None
    for row, (block, bi, _, _, n, h, p) in _rows(batches):
        here, product = (block.as_py(), bi.as_py()), _array(p, n.as_py(), h.as_py())
        if here == at:
            total += product
            continue
        if at is not None:
            yield pa.RecordBatch.from_arrays([*first.columns[:2], *first.columns[3:6], _binary(total)], ["block", "bi", "labels", "n", "h", "p"])
        at, first, total = here, row, product.copy()
    if at is not None:
        yield pa.RecordBatch.from_arrays([*first.columns[:2], *first.columns[3:6], _binary(total)], ["block", "bi", "labels", "n", "h", "p"])


def _peaks(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and rows of the model: largest score, sum of powers below it, and the score of the label, if here."""
        for row, (_, bi, labels, n, h, p) in _rows(batches):
            scores = _array(p, n.as_py(), h.as_py())
            at = labels.values.to_numpy() - bi.as_py() * side
            own = np.full(len(scores), -np.inf)
            here = np.flatnonzero((at >= 0) & (at < scores.shape[1]))
            own[here] = scores[here, at[here]]
            peak = scores.max(axis=1)
            sums = np.exp(scores - peak[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(3), *map(_binary, (peak, sums, own))], ["block", "n", "peak", "sums", "own"])

    return run


def _whole_peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block together: (block, peak, sums) over all classes, and the block's number of rows, loss and squared loss."""

    def out(at: int, peak: np.ndarray, sums: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        with np.errstate(invalid="ignore"):
            loss = np.where(np.isneginf(own), 0.0, -np.log(np.exp(own - peak) / sums + vx.LOSS_FLOOR))  # no class, no target
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), _binary(peak), _binary(sums), pa.array([len(peak)], pa.int64()),
             pa.array([loss.sum()]), pa.array([(loss * loss).sum()])],
            ["block", "peak", "sums", "rows", "loss", "square"],
        )

    at = None
    for _, (block, n, p, s, o) in _rows(batches):
        n = n.as_py()
        new = [_array(v, n) for v in (p, s, o)]
        if block.as_py() != at:
            if at is not None:
                yield out(at, peak, sums, own)
            at, (peak, sums, own) = block.as_py(), new
            continue
        higher = np.maximum(peak, new[0])
        sums = sums * np.exp(peak - higher) + new[1] * np.exp(new[0] - higher)
        peak, own = higher, np.maximum(own, new[2])
    if at is not None:
        yield out(at, peak, sums, own)


def _gradients(number: str, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of differences and vectors, added up per block of the model while a task holds few of them."""
        held: dict[tuple[int, int], np.ndarray] = {}

        def hand_on():
            for (bi, bj), total in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), _binary(total)], ["bi", "bj", "g"])
            held.clear()

        for _, (bi, bj, labels, n, h, p, peak, sums, x) in _rows(batches):
            n, bi, bj = n.as_py(), bi.as_py(), bj.as_py()
            delta = np.exp(_array(p, n, h.as_py()) - _array(peak, n)[:, None]) / _array(sums, n)[:, None]
            at = labels.values.to_numpy() - bi * side
            here = np.flatnonzero((at >= 0) & (at < delta.shape[1]))
            delta[here, at[here]] -= 1.0
            product = delta.T @ np.frombuffer(x.as_buffer(), number).reshape(n, -1).astype(np.float64)
            if (bi, bj) in held:
                held[bi, bj] += product
            else:
                if len(held) >= HELD:
                    yield from hand_on()
                held[bi, bj] = product
        yield from hand_on()

    return run


def _add_gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, None
    for _, (bi, bj, g) in _rows(batches):
        here, new = (bi.as_py(), bj.as_py()), np.frombuffer(g.as_buffer(), "<f8")
        if here == at:
            total = total + new
            continue
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), _binary(total)], ["bi", "bj", "g"])
        at, total = here, new
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), _binary(total)], ["bi", "bj", "g"])


def _step(n: int, lr: float, decay: float, momentum: float, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, (_, _, _, w, v, g) in _rows(batches):
            weights = np.frombuffer(w.as_buffer(), "<f8")
            gradient = np.frombuffer(g.as_buffer(), "<f8") / n
            if not np.isfinite(gradient).all():
                raise ValueError(f"gradient of epoch {epoch} is not finite")
            gradient = gradient + decay * weights
            if momentum > 0:
                gradient = momentum * np.frombuffer(v.as_buffer(), "<f8") + gradient
            velocity = gradient if momentum > 0 else np.frombuffer(v.as_buffer(), "<f8")
            yield pa.RecordBatch.from_arrays([*row.columns[:3], _binary(weights - lr * gradient), _binary(velocity)], ["bi", "bj", "h", "w", "v"])

    return run


def _spread_cells(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (bi, bj, h, w) in _rows(batches):
            matrix = np.frombuffer(w.as_buffer(), "<f8").reshape(h.as_py(), -1)
            i, j = np.indices(matrix.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array((i + bi.as_py() * side).ravel(), pa.int32()), pa.array((j + bj.as_py() * side).ravel(), pa.int32()), pa.array(matrix.ravel())],
                ["i", "j", "w"],
            )

    return run


def train_classifier(
    table: DataFrame, label: str, vec: str, classes: int, initial: DataFrame, epochs: int, lr: float, decay: float = 0.0,
    momentum: float = 0.0, stop_loss: float = 1e-3, path: str | None = None, block_cells: int = blocks.BLOCK_CELLS,
    broadcast_cells: int = blocks.BROADCAST_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """Full-batch descent as in ``learn.train_classifier``: weights ``(i, j, w)`` and the loss per epoch.

    ``initial`` is a ``(row, col, val)`` matrix with ``classes`` rows. Below ``path`` every epoch is a version of the
    model; a call that finds versions there goes on from the newest, up to ``epochs`` in all. Rows with a null
    label or vector are left out; a label without a class has no target and no loss.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "training")
    path = path or scratch.path("state")
    rows, cols = matrix_shape(initial)
    if rows > classes:
        raise ValueError(f"a model of {rows} rows has more than {classes} classes")
    side = max(1, isqrt(block_cells))
    across, down = -(-cols // side), -(-classes // side)
    data = table.filter(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(label).cast("bigint").alias("label"), vec)
    number = "<f4" if data.schema[vec].dataType.elementType.simpleString() == "float" else "<f8"
    x = scratch.write(blocks.vector_blocks(data, "label", vec, cols, side, block_cells, min(classes, side)), "vectors")
    saved = tables.table_versions(spark, f"{path}/model")
    if not saved:
        start = blocks.matrix_blocks(initial, classes, cols, side)
        tables.save_table(start.withColumn("v", F.expr("rpad(X'', octet_length(w), X'00')")), f"{path}/model", "model")
        saved = [1]
    model, done = tables.load_table(spark, f"{path}/model", "model"), saved[-1] - 1
    history = []
    if done:
        history = [tuple(r) for r in tables.load_table(spark, f"{path}/history", "history").orderBy("epoch").collect()][:done]
    small = classes * cols <= broadcast_cells
    for epoch in range(done, epochs):
        if history and history[-1][1] < stop_loss:
            break
        w = model.select("bi", F.col("bj").alias("k0"), "h", "w")
        met = blocks.meet(x, w, [F.col("part")], F.floor(F.col("bi") / blocks.BUNDLE).cast("int"), -(-down // blocks.BUNDLE), across, small)
        parts = met.select("block", "bi", "part", F.col("keys").alias("labels"), "n", "h", "x", "w").mapInArrow(
            _partial_scores(number), "block bigint, bi int, part int, labels array<bigint>, n int, h int, p binary"
        )
        parts = parts.repartition("block", "bi").sortWithinPartitions("block", "bi", "part")
        scores = scratch.write(parts.mapInArrow(_add_scores, _SCORES), f"scores-{epoch}")
        peaks = scores.select("block", "bi", "labels", "n", "h", "p").mapInArrow(
            _peaks(side), "block bigint, n int, peak binary, sums binary, own binary"
        )
        whole = peaks.repartition("block").sortWithinPartitions("block").mapInArrow(
            _whole_peaks, "block bigint, peak binary, sums binary, rows bigint, loss double, square double"
        )
        whole = scratch.write(whole, f"peaks-{epoch}")
        n, loss, square = whole.agg(F.sum("rows"), F.sum("loss"), F.sum("square")).first()
        if not n:
            raise ValueError("no row has a label and a vector")
        mean = loss / n
        history.append((epoch, mean, float(np.sqrt(max(square / n - mean * mean, 0.0))), n))
        if not mean < stop_loss:
            sides = scores.join(whole.select("block", "peak", "sums"), "block").join(x.select("block", F.col("part").alias("bj"), "x"), "block")
            shares = sides.select("bi", "bj", "labels", "n", "h", "p", "peak", "sums", "x").mapInArrow(
                _gradients(number, side), "bi int, bj int, g binary"
            )
            gradient = shares.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_add_gradients, "bi int, bj int, g binary")
            stepped = model.join(gradient, ["bi", "bj"]).select("bi", "bj", "h", "w", "v", "g").mapInArrow(
                _step(n, lr, decay, momentum, epoch), "bi int, bj int, h int, w binary, v binary"
            )
            tables.save_table(spark.createDataFrame(history, tables.SCHEMAS["history"]), f"{path}/history", "history")
            tables.save_table(stepped, f"{path}/model", "model")
            model = tables.load_table(spark, f"{path}/model", "model")
            tables.drop_versions(spark, f"{path}/model", keep=2)
            tables.drop_versions(spark, f"{path}/history", keep=2)
        scratch.drop(f"scores-{epoch}")
        scratch.drop(f"peaks-{epoch}")
    scratch.drop("vectors")
    cells = model.select("bi", "bj", "h", "w").mapInArrow(_spread_cells(side), "i int, j int, w double")
    return cells, spark.createDataFrame(history, tables.SCHEMAS["history"])

