"""Joins behind a Bloom filter against the plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import bloom


def read(frame):
    return sorted(map(str, map(tuple, frame.collect())))


@pytest.mark.parametrize("most_bits", [64, 1 << 27])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_rows_are_those_of_the_plain_join(spark, most_bits, kind):
    """Also with a filter that is far too small and lets nearly everything through."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice([None, *range(3000)]), k) for k in range(5000)], "key int, n int").repartition(5)
    keys = spark.createDataFrame([(rng.choice([None, *range(2500, 3500)]), 1) for _ in range(400)], "key int, n int").repartition(3)
    rows, keys = (t.withColumn("key", F.col("key").cast(kind)) for t in (rows, keys))
    assert read(bloom.semi_join(rows, keys, "key", most_bits)) == read(rows.join(keys.select("key").distinct(), "key", "left_semi"))
    assert read(bloom.anti_join(rows, keys, "key", most_bits)) == read(rows.join(keys.select("key").distinct(), "key", "left_anti"))


def test_few_rows_are_shuffled(spark):
    rows, keys = spark.range(20_000).withColumnRenamed("id", "key"), spark.range(19_900, 30_000).withColumnRenamed("id", "key")
    n, shuffled, matched = bloom.filter_report(rows, keys, "key").first()
    assert (n, matched) == (20_000, 100) and 100 <= shuffled < 100 + 20_000 * 0.03


def test_nothing_to_join(spark):
    rows = spark.createDataFrame([(1,), (None,)], "key int")
    assert read(bloom.semi_join(rows, rows.limit(0), "key")) == [] and read(bloom.anti_join(rows, rows.limit(0), "key")) == read(rows)
    assert read(bloom.semi_join(rows.limit(0), rows, "key")) == read(bloom.anti_join(rows.limit(0), rows, "key")) == []
    nulls = rows.filter("key is null")
    assert read(bloom.semi_join(rows, nulls, "key")) == [] and read(bloom.anti_join(rows, nulls, "key")) == read(rows)
