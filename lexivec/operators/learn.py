"""Data-parallel gradients and stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import vectors as vx
from lexivec.functions.arrays import dense, dense_pair, ragged, rowwise
from lexivec.operators.linear import small_matrix


def predictions(table: DataFrame, weights: np.ndarray, vec: str) -> DataFrame:
    """Adds the scores ``W x`` and their softmax."""
    scored = table.withColumn("logits", rowwise(lambda x: x.astype(np.float64) @ weights.T)(F.col(vec)))
    return scored.withColumn("p", vx.softmax(F.col("logits")))


def with_targets(table: DataFrame, label: str, classes: int) -> DataFrame:
    return table.withColumn("y", vx.one_hot(F.col(label), classes))


def loss_by_label(predicted: DataFrame, label: str) -> DataFrame:
    """Mean cross entropy per label, from probabilities and from raw scores."""
    return predicted.groupBy(label).agg(
        F.avg(vx.cross_entropy(F.col("p"), F.col("y"))).alias("loss"),
        F.avg(vx.cross_entropy_logits(F.col("logits"), F.col("y"))).alias("loss_logits"),
        F.count(F.lit(1)).alias("n"),
    )


def softmax_gradient(predicted: DataFrame) -> DataFrame:
    """Adds ``delta = p - y``."""
    return predicted.withColumn("delta", F.zip_with("p", "y", lambda p, y: p - y))


def outer_gradient(table: DataFrame, delta: str, x: str) -> DataFrame:
    """Sum over the rows of ``delta`` times ``x``: ``(i, j, g)``.

    Every task adds up its own rows with one matrix product and emits one row per cell.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            d, v, _ = dense_pair(batch.column(0), batch.column(1))
            if d.size:
                product = d.astype(np.float64).T @ v.astype(np.float64)
                total = product if total is None else total + product
        if total is not None:
            yield _cells(total)

    rows = table.select(delta, x)
    return rows.mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def _cells(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(matrix.shape)
    return pa.RecordBatch.from_pydict(
        {
            "i": pa.array(i.ravel(), pa.int32()),
            "j": pa.array(j.ravel(), pa.int32()),
            "g": pa.array(matrix.ravel(), pa.float64()),
        }
    )


def chain_gradient(table: DataFrame, weights: np.ndarray, key: str, delta: str, z: str) -> DataFrame:
    """``(W^T delta) * silu'(z)`` of every row: ``(key, dz)``. NULL where either vector is missing."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, v, missing = dense_pair(batch.column(1), batch.column(2))
            if d.size:
                gate = 1.0 / (1.0 + np.exp(-v.astype(np.float64)))
                d = (d.astype(np.float64) @ weights) * gate * (1.0 + v * (1.0 - gate))
            out = ragged(d, missing, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "dz"])

    key_kind = table.schema[key].dataType.simpleString()
    return table.select(key, delta, z).mapInArrow(back, f"{key} {key_kind}, dz array<double>")


def sgd_step(
    weights: DataFrame, gradient: DataFrame, lr: float, decay: float = 0.0, momentum: float = 0.0,
    damping: float = 0.0, nesterov: bool = False,
) -> DataFrame:
    """One update of ``(i, j, w, v)`` by ``(i, j, g)``: decay, momentum, look-ahead, step.

    A cell without a gradient has gradient 0.
    """
    g = F.coalesce(F.col("g"), F.lit(0.0))
    if decay > 0:
        g = g + decay * F.col("w")
    v = F.col("v")
    if momentum > 0:
        v = momentum * v + (1.0 - damping) * g
        g = g + momentum * v if nesterov else v
    joined = weights.join(gradient.select("i", "j", "g"), ["i", "j"], "left")
    return joined.select("i", "j", (F.col("w") - lr * g).alias("w"), v.alias("v"))


def finite_guard(table: DataFrame, vecs: list[str]) -> DataFrame:
    """Per vector column: elements, NaN and infinite elements, and whether all are finite."""
    parts = []
    measures = []
    for name in vecs:
        nan = F.size(F.filter(name, lambda x: F.isnan(x)))
        inf = F.size(F.filter(name, lambda x: F.abs(x) == float("inf")))
        measures += [
            F.sum(F.size(name)).cast("bigint").alias(f"{name}_n"),
            F.sum(nan).cast("bigint").alias(f"{name}_nan"),
            F.sum(inf).cast("bigint").alias(f"{name}_inf"),
        ]
        bad = F.col(f"{name}_nan") + F.col(f"{name}_inf")
        parts.append(
            F.struct(
                F.lit(name).alias("column"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_nan").alias("n_nan"),
                F.col(f"{name}_inf").alias("n_inf"), (bad == 0).alias("ok"),
            )
        )
    return table.agg(*measures).select(F.inline(F.array(*parts)))


def require_finite(table: DataFrame, vecs: list[str]) -> None:
    """Raise when a vector column holds NaN or infinity."""
    for row in finite_guard(table, vecs).filter("not ok").collect():
        raise ValueError(f"{row['column']}: {row['n_nan']} NaN, {row['n_inf']} infinite elements")


def _of_width(vec: str, width: int) -> Column:
    wrong = F.raise_error(F.lit(f"{vec} holds a vector without {width} elements"))
    return F.when(F.size(vec) == width, F.col(vec)).when(F.col(vec).isNotNull(), wrong)


def scatter_add(table: DataFrame, row_id: str, vec: str, width: int) -> DataFrame:
    """Add gradient vectors into the rows of a table by id: ``(id, j, g)``.

    The vector is summed column by column in one map-side combined aggregation; it is spread to
    rows only after the sum. A vector that is not ``width`` long fails, a NULL vector adds nothing.
    """
    vec = _of_width(vec, width)
    sums = table.groupBy(row_id).agg(
        F.array(*[F.sum(F.get(vec, F.lit(j)).cast("double")) for j in range(width)]).alias("g")
    )
    return sums.select(F.col(row_id).alias("id"), F.posexplode("g").alias("j", "g"))


def column_sums(table: DataFrame, vec: str, width: int, into: str) -> DataFrame:
    """Sum of a vector column over the whole table: ``(j, into)``; lengths as in ``scatter_add``."""
    vec = _of_width(vec, width)
    sums = table.agg(F.array(*[F.sum(F.get(vec, F.lit(j)).cast("double")) for j in range(width)]).alias("s"))
    return sums.select(F.posexplode("s").alias("j", into))


def train_classifier(
    table: DataFrame, label: str, vec: str, classes: int, initial: DataFrame, epochs: int, lr: float,
    decay: float = 0.0, momentum: float = 0.0, stop_loss: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """Full-batch descent on a softmax classifier; returns weights and the loss per epoch.

    One job per epoch: every task computes scores, losses and its share of the gradient in one
    pass, the shares are summed per cell, and the summed cells (classes times width, a size that
    does not depend on the data) update the model. Stops early once the mean loss is below
    ``stop_loss``.
    """
    spark = table.sparkSession
    data = table.select(F.col(label).alias("label"), F.col(vec).alias("vec"))
    data = data.filter("label is not null and vec is not null").persist(StorageLevel.MEMORY_AND_DISK)
    matrix = small_matrix(initial)
    velocity = np.zeros_like(matrix)
    history = []
    for epoch in range(epochs):
        sums = {(r["i"], r["j"]): r["g"] for r in _epoch(data, matrix, classes).collect()}
        n, loss, square = sums[(-1, 0)], sums[(-1, 1)], sums[(-1, 2)]
        mean = loss / n
        history.append((epoch, mean, float(np.sqrt(max(square / n - mean * mean, 0.0))), int(n)))
        if mean < stop_loss:
            break
        gradient = np.array([[sums[(i, j)] for j in range(matrix.shape[1])] for i in range(classes)]) / n
        if not np.isfinite(gradient).all():
            raise ValueError(f"gradient of epoch {epoch} is not finite")
        gradient += decay * matrix
        if momentum > 0:
            velocity = momentum * velocity + gradient
            gradient = velocity
        matrix = matrix - lr * gradient
    data.unpersist()
    cells = [(i, j, float(matrix[i, j])) for i in range(classes) for j in range(matrix.shape[1])]
    return (
        spark.createDataFrame(cells, "i int, j int, w double"),
        spark.createDataFrame(history, "epoch int, mean_loss double, std_loss double, n bigint"),
    )


def _epoch(data: DataFrame, weights: np.ndarray, classes: int) -> DataFrame:
    """Summed gradient cells; row -1 carries count, loss and squared loss."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, stats = np.zeros_like(weights), np.zeros(3)
        for batch in batches:
            x, _ = dense(batch.column(1))
            if not x.size:
                continue
            x, labels = x.astype(np.float64), batch.column(0).to_numpy(zero_copy_only=False)
            scores = x @ weights.T
            power = np.exp(scores - scores.max(axis=1, keepdims=True))
            p = power / power.sum(axis=1, keepdims=True)
            y = np.equal.outer(labels, np.arange(classes)).astype(np.float64)
            losses = -(y * np.log(p + vx.LOSS_FLOOR)).sum(axis=1)
            gradient += (p - y).T @ x
            stats += [len(x), losses.sum(), (losses * losses).sum()]
        cells = _cells(gradient).to_pydict()
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array([*cells["i"], -1, -1, -1], pa.int32()),
                "j": pa.array([*cells["j"], 0, 1, 2], pa.int32()),
                "g": pa.array([*cells["g"], *stats], pa.float64()),
            }
        )

    return data.mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
