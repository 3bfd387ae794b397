"""Random matrices, splits and permutations of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions import random as rn
from lexivec.operators.ordering import global_rank
from lexivec.scratch import Scratch


def random_matrix(spark: SparkSession, rows: int, cols: int, fill: Callable[[Column], Column]) -> DataFrame:
    """A row-major filled matrix ``(row, col, val)``; ``fill`` maps the draw number to a value."""
    cells = spark.range(rows * cols)
    return cells.select(
        F.floor(F.col("id") / cols).alias("row"),
        (F.col("id") % cols).cast("int").alias("col"),
        fill(F.col("id") + 1).alias("val"),
    )


def xavier_matrix(spark: SparkSession, rows: int, cols: int, seed: int) -> DataFrame:
    return random_matrix(spark, rows, cols, lambda k: rn.xavier(k, rows, cols, seed))


def muller_matrix(spark: SparkSession, rows: int, cols: int, seed: int) -> DataFrame:
    return random_matrix(spark, rows, cols, lambda k: rn.muller(k, rows, cols, seed))


def matrix_rows(cells: DataFrame) -> DataFrame:
    """Cells gathered to ``(row, vec)``."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "val")))
    return cells.groupBy("row").agg(F.transform(ordered, lambda c: c["val"]).alias("vec"))


def shuffle_rows(table: DataFrame, index: str, seed: int, scratch: Scratch | None = None) -> DataFrame:
    """A reproducible permutation: rows in the order of their own draw, numbered from 1."""
    drawn = table.withColumn("_draw", rn.lehmer_int(F.col(index) + 1, seed))
    return global_rank(drawn, ["_draw", index], into="position", scratch=scratch).drop("_draw")


def exchange_order(spark: SparkSession, n: int, seed: int, scratch: Scratch) -> DataFrame:
    """``(position, origin)``: where each element of a serial exchange shuffle of ``n`` elements comes from, both from 0.

    The serial shuffle goes down from place i = n - 1 to 1, draws j = draw % (i + 1) and exchanges the places i and j. So place i
    is final after its step, and holds what place j held before it. Place j last changed in the latest step before that
    also drew j: that is the next larger i'' with the same j, and it brought what place i'' held then; if there is none, j still
    holds j. What place i holds before its own step follows in the same way from the smallest i' > i that drew i, and
    so on: a chain of growing places, followed to its end in doubling steps.

    Draws have random access, so every step is a row of its own. About ln(n / j) steps draw j, so no group is large,
    and chains are as short: a few equi-joins and one window, with no task that holds the table.
    """
    i = F.col("id").alias("i")
    drawn = F.pmod(rn.lehmer_int(F.lit(n) - F.col("id"), seed), F.col("id") + 1).alias("j")
    steps = scratch.write(spark.range(1, max(n, 1)).select(i, drawn), "steps")
    chain = scratch.write(steps.filter("i <> j").groupBy(F.col("j").alias("p")).agg(F.min("i").alias("up")), "chain-0")
    turn = 0
    while True:
        on = chain.select(F.col("p").alias("q"), F.col("up").alias("further"))
        if chain.join(on, F.col("up") == F.col("q"), "left_semi").isEmpty():
            break
        turn += 1
        longer = chain.join(on, F.col("up") == F.col("q"), "left").select("p", F.coalesce("further", "up").alias("up"))
        chain = scratch.write(longer, f"chain-{turn}")
        scratch.drop(f"chain-{turn - 1}")
    later = F.lead("i").over(Window.partitionBy("j").orderBy("i"))
    moved = steps.filter("i <> j").select("i", "j", later.alias("from"))
    kept = steps.filter("i = j").select("i", "j", F.col("i").alias("from"))
    if n > 0:  # place 0 has no step of its own
        kept = kept.unionByName(spark.range(1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("id").alias("from")))
    return moved.unionByName(kept).join(chain, F.col("from") == F.col("p"), "left").select(
        F.col("i").alias("position"), F.coalesce("up", "from", "j").alias("origin")
    )


def exchange_rows(table: DataFrame, order: list[str], seed: int, scratch: Scratch | None = None) -> DataFrame:
    """The serial exchange shuffle of the rows of a table, which lie in the given total order: adds ``position`` from 0.

    The same permutation as one pass over an array with the same seed, from joins; see ``exchange_order``.
    """
    scratch = scratch or Scratch(table.sparkSession, "exchange")
    ranked = scratch.write(global_rank(table, order, into="_rank", scratch=scratch), "ranked")
    places = exchange_order(table.sparkSession, ranked.count(), seed, scratch)
    return ranked.join(places, F.col("_rank") - 1 == F.col("origin")).select(*table.columns, "position")
