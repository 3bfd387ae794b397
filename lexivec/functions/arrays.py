"""Vector columns as numpy matrices inside Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dense(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The non-null rows of a list array as a matrix, and the mask of null rows."""
    missing = np.asarray(vectors.is_null().to_numpy(zero_copy_only=False))
    rows = vectors.drop_null() if missing.any() else vectors
    if len(rows) == 0:
        return np.empty((0, 0)), missing
    widths = pc.list_value_length(rows)
    span = pc.min_max(widths).as_py()
    if span["min"] != span["max"]:
        raise ValueError(f"vectors of {span['min']} to {span['max']} elements in one column")
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), span["max"]), missing


def dense_pair(first: pa.Array, second: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two columns as matrices over the rows that have both vectors, and the mask of the others."""
    missing = pc.or_(first.is_null(), second.is_null())
    kept = pc.invert(missing)
    rows = [dense(column.filter(kept))[0] for column in (first, second)]
    return rows[0], rows[1], np.asarray(missing.to_numpy(zero_copy_only=False))


def ragged(matrix: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Inverse of ``dense``."""
    width = matrix.shape[1] if matrix.size else 0
    ends = np.concatenate([[0], np.cumsum(np.where(missing, 0, width))]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(matrix.ravel(), kind), mask=pa.array(missing)
    )


def rowwise(fn: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> Callable[[Column], Column]:
    """Lift a function on matrices (one row per vector) to a vector column."""
    arrow = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32()}[kind]

    def apply(vectors: pa.Array) -> pa.Array:
        matrix, missing = dense(vectors)
        return ragged(fn(matrix) if matrix.size else matrix, missing, arrow)

    return F.arrow_udf(apply, f"array<{kind}>")

