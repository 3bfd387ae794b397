"""Whitening of embeddings by shifted Cholesky QR.

Entries are fixed-point numbers, x = floor(256 c). The fit takes every distinct vector once: A is the matrix of
these rows, centred. A Gram pass sums A'A over tasks; the Cholesky factor R1 of A'A plus a small multiple of the
identity (the shift, 11 (n d + d (d + 1)) u |A|^2) always exists, and the rows A R1^-1, found by triangular
solves, are nearly orthogonal. Further passes take the Gram matrix of these rows, factor it and go on with
R = Rk ... R1 until it is the identity; rows are solved again from the stored integers in each pass, so no pass
writes them. Then A = Q R with orthonormal Q, and the singular values s and right vectors w of R are those of A:
w are the unit eigenvectors of the covariance (divisor n) and s^2 / n its eigenvalues. A last pass measures the
covariance of the whitened rows.

Scale: each pass reads the fit list once; a task holds one batch and one d x d matrix, and only matrices are
shuffled. The driver holds d x d numbers, whatever the number of rows.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity are left out; vectors shorter
than the longest count as zero in the missing places; equal rows give equal rows; components whose eigenvalue
is below ``RANK`` of the largest are not returned, so a table with one distinct vector, or none, gives no
rows; a null id stays null; a deviation beyond a long is null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.scratch import Scratch

#: Units of a fixed-point entry in 1.
UNITS = 256
#: Largest entry of Q'Q - I that counts as orthonormal, and passes at most (directions without variance never are).
ORTHONORMAL, PASSES = 1e-13, 5
#: Eigenvalues below this share of the largest are no components.
RANK = 1e-12
_EPS = float(np.finfo(np.float64).eps)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries end to end as doubles, bounds of the rows, and which rows are whole and finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return values, bounds, column.is_valid().to_numpy(zero_copy_only=False) & (bad[bounds[1:]] == bad[bounds[:-1]])


def _fixed_point(units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds, whole = _values(batch.column(1))
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(values * units)
            x = np.clip(np.nan_to_num(scaled), -(2.0**63), 2.0**63 - 1024).astype("<i8")
            rows = [x[bounds[k] : bounds[k + 1]].tobytes() for k in np.flatnonzero(whole)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(whole)), pa.array(rows, pa.binary())], ["vec_id", "x"]
            )

    return run


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), d)


def _cells(matrix: np.ndarray) -> pa.RecordBatch:
    """The upper triangle of a symmetric matrix, a row per cell."""
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(matrix[i, j])], ["i", "j", "v"])


def _solved(x: np.ndarray, mean: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows of (x - mean) R1^-1 ... Rk^-1."""
    rows = (x - mean).T
    for r in factors:
        rows = _forward(r.T, rows)
    return rows.T


def _forward(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Solve lower * out = rows from the top, in blocks."""
    out = np.empty_like(rows)
    width = 32
    for a in range(0, len(lower), width):
        b = min(a + width, len(lower))
        part = rows[a:b] - lower[a:b, :a] @ out[:a]
        for k in range(a, b):
            out[k] = (part[k - a] - lower[k, a:k] @ out[a:k]) / lower[k, k]
    return out


def _gram(d: int, mean: np.ndarray, factors: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                rows = _solved(_matrix(batch.column(0), d), mean, factors)
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield _cells(total)

    return run


def _sums(d: int):
    """(i, v, n): sums per dimension and rows of a task, as decimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # no sum of a batch can overflow
            total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * d, pa.int64())], ["i", "v", "n"]
            )

    return run


def _summed(fit: DataFrame, task, d: int) -> np.ndarray:
    cells = fit.mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    i, j, v = (cells.column(k).to_numpy() for k in ("i", "j", "v"))
    out[i, j] = v
    out[j, i] = v
    return out


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor; where rounding makes the matrix indefinite the shift grows until one exists."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, _EPS * max(float(np.trace(gram)), np.finfo(np.float64).tiny / _EPS))


class Fit:
    """Mean, eigenvalues and unit eigenvectors (columns, by falling eigenvalue) of the distinct rows."""

    def __init__(self, n: int, sums: list[int], d: int):
        self.n, self.sums, self.d = n, sums, d
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(d)
        self.values, self.vectors, self.trace = np.zeros(0), np.zeros((d, 0)), 0.0

    def solve(self, fit: DataFrame) -> None:
        n, d = self.n, self.d
        gram = _summed(fit, _gram(d, self.mean, []), d)
        if not np.trace(gram) > 0:
            return
        norm = float(np.linalg.norm(gram, 2))
        factors = [_factor(gram, 11 * (n * d + d * (d + 1)) * _EPS / 2 * norm)]
        for _ in range(PASSES):
            gram = _summed(fit, _gram(d, self.mean, factors), d)
            if np.abs(gram - np.eye(d)).max() <= ORTHONORMAL:
                break
            factors.append(_factor(gram, 0.0))
        r = factors[0]
        for later in factors[1:]:
            r = later @ r
        _, s, right = np.linalg.svd(r)
        values = s**2 / n
        kept = values > values[0] * RANK
        self.values, self.vectors, self.trace = values[kept], right[kept].T, float(values.sum())


def fit_components(rows: DataFrame, d: int) -> Fit:
    """The components of the distinct rows of ``rows(x)``, d little-endian longs each."""
    sums = rows.mapInArrow(_sums(d), "i int, v string, n bigint").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"), F.sum("n").alias("n")
    ).collect()  # one row a dimension
    if not sums:
        return Fit(0, [0] * d, d)
    out = Fit(sums[0]["n"], [int(r["v"]) for r in sorted(sums, key=lambda r: r["i"])], d)
    out.solve(rows)
    return out


def _project(x: np.ndarray, fit: Fit, most: int) -> np.ndarray:
    return (x - fit.mean) @ fit.vectors[:, :most] / np.sqrt(fit.values[:most])


def _whitened_gram(fit: Fit, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, d = np.zeros((most, most)), fit.d
        for batch in batches:
            rows = _project(_matrix(batch.column(0), d), fit, most)
            total += rows.T @ rows
        yield _cells(total)

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None beyond a long."""
    if len(x) == 0:
        return []
    furthest = max((n * int(e) - s) ** 2 for low, s in zip((x.min(axis=0), x.max(axis=0)), (sums, sums)) for e, s in zip(low, s))
    if furthest * x.shape[1] < 1 << 63 and max(map(abs, sums)) < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _output(fit: Fit, most: int, error: float):
    explained = fit.values[:most] / fit.trace if most else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), fit.d)
            m = len(x) * most
            rows = pa.array(np.repeat(np.arange(len(x)), most))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(m, fit.n)), pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(rows),
                 pa.array(_project(x, fit, most).reshape(m)), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, most: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): the first ``most`` whitened components of each row."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.write(
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("c")).mapInArrow(_fixed_point(UNITS), f"vec_id {kind}, x binary"),
        "rows",
    )
    d = (rows.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8
    shape = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if d == 0:
        return vectors.sparkSession.createDataFrame([], shape)
    rows = rows.withColumn("x", F.expr(f"rpad(x, {8 * d}, X'00')"))
    fit_rows = scratch.write(rows.select("x").distinct(), "fit")
    fit = fit_components(fit_rows, d)
    most = min(most, len(fit.values))
    error = 0.0
    if most:
        gram = _summed(fit_rows, _whitened_gram(fit, most), most)
        error = float(np.abs(gram / fit.n - np.eye(most)).max())
    scratch.drop("fit")
    return rows.mapInArrow(_output(fit, most, error), shape)
