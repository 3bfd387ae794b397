"""Total orders over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.scratch import Scratch


def global_rank(
    table: DataFrame, order: list[str], group: list[str] | None = None, into: str = "rank", scratch: Scratch | None = None
) -> DataFrame:
    """Number the rows from 1 in the given order, over the table or within each group.

    The rows are range-partitioned and sorted once and stored with their place in the partition;
    the offset of each partition comes from one count per partition and group. No task sees a
    whole group, so a group may hold any share of the rows. The stored copy is the caller's to drop: with
    a ``scratch`` of its own it goes when that is left.
    """
    group = group or []
    keys = [*group, *order]
    scratch = scratch or Scratch(table.sparkSession, "rank")
    placed = table.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")
    )
    stored = scratch.write(placed, f"rows-{len(scratch.names)}")
    sizes = stored.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rank = F.col("_offset") + F.col("_place") - F.col("_first") + 1
    return stored.join(offsets, same).select(*table.columns, rank.alias(into))


def sorted_rank(table: DataFrame, key: str, tie: str, scratch: Scratch | None = None) -> DataFrame:
    """Ascending numeric sort with its ranks; the tie column lets equal keys span partitions."""
    return global_rank(table.select(key, tie), [key, tie], scratch=scratch)


def sorted_rank_bytes(table: DataFrame, key: str, tie: str, scratch: Scratch | None = None) -> DataFrame:
    """Ascending byte-order sort of strings with its ranks; strings compare by their bytes."""
    return global_rank(table.select(key, tie), [key, tie], scratch=scratch)
