"""Spread small inputs over the available cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLIT_BYTES = 32 << 20
MOST_BYTES = 2 << 30  # whatever the cluster, larger inputs are never shuffled for this


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a small input that may sit in one file block; leave a large one as it is.

    A table of many blocks is already split well and shuffling it would cost more than it brings.
    A small one often has a single block, and the work per row is what takes the time. The size
    is the optimizer's estimate for the projected columns.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < min(cores * SPLIT_BYTES, MOST_BYTES) else df
