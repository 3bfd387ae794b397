"""Keyed tables stored by buckets of their key, so that batches join them without moving them.

The rows of a table lie in a fixed number of buckets by a hash of the key, each sorted by it. A join or an
aggregation on the key reads a bucket as it lies: only the batch is shuffled, into as many partitions as the table has
buckets. The tables are in the session's catalog, which knows the buckets, and their files in the folder of
intermediate tables, which every executor reaches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators import keyed
from lexivec.scratch import Scratch


class KeyedStore:
    """A bucketed table ``(key, value)`` with first-wins inserts, lookups and deletions.

    Every change writes a new generation beside the old one, which is dropped when the next is complete, so
    a reader that holds a frame of the generation before last is the only one to fail. Null keys are keys
    like any other; lookups of a null key find nothing, as in any equi-join.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, value: str, buckets: int):
        self.spark, self.name, self.key, self.value, self.buckets = spark, name, key, value, buckets
        self.scratch = Scratch(spark, "store")
        self.generation: str | None = None
        self.previous: str | None = None

    def table(self) -> DataFrame:
        if self.generation is None:
            raise ValueError(f"{self.name} has no rows yet: create it first")
        return self.spark.table(self.generation)

    def _replace(self, rows: DataFrame) -> KeyedStore:
        fresh = f"{self.name}_{uuid.uuid4().hex}"
        # The rows come by their key in as many partitions as there are buckets, so every bucket is one file.
        placed = rows.select(self.key, self.value).repartition(self.buckets, self.key)
        files = placed.write.format("parquet").option("path", self.scratch.path(fresh))
        files.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(fresh)
        self._forget(self.previous)
        self.previous, self.generation = self.generation, fresh
        return self

    def _forget(self, name: str | None) -> None:
        if name is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(name)

    def create(self, rows: DataFrame, arrival: str) -> KeyedStore:
        """The first generation: of the rows of one key the earliest."""
        return self._replace(keyed.first_wins_upsert(rows.limit(0), rows, self.key, self.value, arrival))

    def _incoming(self, batch: DataFrame) -> DataFrame:
        return batch.repartition(self.buckets, self.key)

    def upsert(self, batch: DataFrame, arrival: str) -> KeyedStore:
        """Insert a batch: a key that is there keeps its value, a new one takes that of its earliest row.

        The batch is reduced to a row per key by map-side combined aggregation, and meets the stored buckets where they lie.
        """
        earliest = F.min(F.struct(F.col(arrival).alias("at"), F.col(self.value).alias("v"))).alias("r")
        new = self._incoming(batch.groupBy(self.key).agg(earliest))
        old = self.table().withColumnRenamed(self.key, "_old").withColumnRenamed(self.value, "_value").withColumn("_there", F.lit(True))
        both = new.hint("merge").join(old, new[self.key].eqNullSafe(old["_old"]), "full")
        return self._replace(
            both.select(
                F.when(F.col("_there"), F.col("_old")).otherwise(F.col(self.key)).alias(self.key),
                F.when(F.col("_there"), F.col("_value")).otherwise(F.col("r.v")).alias(self.value),
            )
        )

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Every row with the value of its key, null where the key is absent."""
        return self._incoming(rows).hint("merge").join(self.table(), self.key, "left")

    def contains(self, candidates: DataFrame) -> DataFrame:
        """Each distinct candidate with a membership flag."""
        flagged = self.table().select(self.key, F.lit(True).alias("found"))
        distinct = self._incoming(candidates.select(self.key).distinct())
        return distinct.hint("merge").join(flagged, self.key, "left").select(self.key, F.coalesce("found", F.lit(False)).alias("found"))

    def delete(self, keys: DataFrame) -> KeyedStore:
        """Drop the given keys."""
        gone = self._incoming(keys.select(F.col(self.key).alias("_gone")).distinct().withColumnRenamed("_gone", self.key))
        return self._replace(self.table().join(gone.hint("merge"), self.key, "left_anti"))

    def drop(self) -> None:
        """Remove both generations."""
        for name in (self.previous, self.generation):
            self._forget(name)
        self.previous = self.generation = None
