"""Keyed tables and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def first_wins_upsert(existing: DataFrame, batch: DataFrame, key: str, value: str, arrival: str) -> DataFrame:
    """Insert a batch; a key that exists keeps its value, a new key takes its earliest row.

    The arrival is compared in its own type; equal arrivals go to the smaller value. One aggregation over both tables, combined map-side, so a key with very many rows in the
    batch arrives as one row per task.
    """
    none = F.lit(None).cast(batch.schema[arrival].dataType)
    old = existing.select(key, F.struct(F.lit(0).alias("late"), none.alias("at"), value).alias("r"))
    new = batch.select(key, F.struct(F.lit(1).alias("late"), F.col(arrival).alias("at"), value).alias("r"))
    first = old.unionByName(new).groupBy(key).agg(F.min("r").alias("r"))
    return first.select(key, F.col(f"r.{value}").alias(value))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Point lookup of every row, NULL where the key is absent.

    A plain join: the table is moved once. Adaptive execution splits the rows of a hot key, also equal
    ones, over several tasks that read the same part of the table.
    """
    return rows.join(table, key, "left")


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def keys_not_found(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Requested keys that the table does not hold."""
    return keys.select(key).distinct().join(table.select(key).distinct(), key, "left_anti")


def table_stats(name: str, table: DataFrame, key: str) -> DataFrame:
    """Row count, emptiness and key type."""
    kind = table.schema[key].dataType.simpleString()
    return table.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("name"),
        "n_rows",
        (F.col("n_rows") == 0).alias("is_empty"),
        F.lit(kind).alias("key_type"),
    )


def set_contains(candidates: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Each distinct candidate with a membership flag."""
    flagged = members.select(key).distinct().withColumn("found", F.lit(True))
    return candidates.select(key).distinct().join(flagged, key, "left").select(
        key, F.coalesce("found", F.lit(False)).alias("found")
    )


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides are made distinct map-side first, so repeated elements never meet in one task."""
    return a.distinct().intersect(b.distinct())


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().subtract(b.distinct())


def set_add(members: DataFrame, more: DataFrame) -> DataFrame:
    return set_union(members, more)


def set_remove(members: DataFrame, fewer: DataFrame) -> DataFrame:
    return set_difference(members, fewer)


def set_clear(members: DataFrame) -> DataFrame:
    return members.limit(0)


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct element with the sides that hold it: one aggregation, combined map-side."""
    marked = [s.withColumns({"in_a": F.lit(k == 0), "in_b": F.lit(k == 1)}) for k, s in enumerate((a, b))]
    return marked[0].union(marked[1]).groupBy(*a.columns).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def set_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: is every element of ``a`` in ``b``?"""
    return _sides(a, b).agg((F.count_if(F.col("in_a") & ~F.col("in_b")) == 0).alias("holds"))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do both sets hold the same elements?"""
    return _sides(a, b).agg((F.count_if(F.col("in_a") != F.col("in_b")) == 0).alias("holds"))
