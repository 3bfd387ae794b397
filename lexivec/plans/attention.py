"""The attention block of a layer as one job: norm, projections, rotation, attention, projection, residual."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import vectors as vx
from lexivec.functions.arrays import rowwise
from lexivec.operators import linear


def _times(weights: np.ndarray):
    """Product of a matrix with every vector; another length fails."""

    def apply(x: np.ndarray) -> np.ndarray:
        if x.shape[1] != weights.shape[1]:
            raise ValueError(f"a vector of {x.shape[1]} elements meets a matrix of {weights.shape[1]} columns")
        return x.astype(np.float64) @ weights.T

    return rowwise(apply)


def attention_block(
    table: DataFrame, sequence: str, order: str, key: str, vec: str, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray,
    wo: np.ndarray, heads: int, kv_heads: int, block: int = linear.ATTENTION_BLOCK,
) -> DataFrame:
    """``x + Wo attention(Wq n, Wk n, Wv n)`` with ``n`` the normalised row; rows of a sequence see those before them."""
    rows = linear.sequence_positions(table, sequence, order)
    normal = rows.select(sequence, "pos", key, vx.rmsnorm(F.col(vec), F.transform(vec, lambda _: F.lit(1.0))).alias("n"))
    parts = normal.select(sequence, "pos", key, *(_times(w)(F.col("n")).alias(c) for c, w in (("q", wq), ("k", wk), ("v", wv))))
    seen = linear.causal_attention(parts, [sequence], key, heads, kv_heads, block=block)
    return linear.residual_add(table.select(key, vec), seen.select(key, _times(wo)(F.col("out")).alias(vec)), key, vec)
