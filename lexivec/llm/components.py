"""Connected components of an edge table, by alternating stars.

Every round links each node's larger neighbours, then its smaller ones, to the smallest neighbour
(large-star, small-star). The edge table never grows beyond its first size, rounds are few
(logarithmic), and the smallest node of a component becomes its centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.scratch import Scratch


def _unfinished(links: DataFrame) -> bool:
    """Whether some node has two centres, or is a centre and has one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("has"), F.lit(0).alias("is")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("has"), F.lit(1).alias("is"))
    )
    sums = ends.groupBy("node").agg(F.sum("has").alias("has"), F.max("is").alias("is"))
    return not sums.filter("has + is > 1 and has > 0").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = scratch.write(links, f"{name}-0")
    turn = 0
    while _unfinished(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        links = scratch.write(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
