"""From documents to packed training sequences, one operator after the other.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns the
columns of ``documents``; the last returns the packed pieces. Stages are written and read again between
two calls; ``run`` does so in the folder of intermediate tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import decontaminate, neardup, packing, suffix, toxicity
from lexivec.scratch import Scratch

#: Bytes of a string that must not occur twice: passages of fifty words and more have them, chance repeats do not.
PASSAGE = 250

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the classifier learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = toxicity.without_toxic(docs.select(*COLUMNS), labels)
    return kept.select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every component of near-duplicates."""
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("k")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["k"]), "left_semi").select(*COLUMNS)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE`` bytes that occur again; whole characters only."""
    return suffix.cut_texts(docs.select(*COLUMNS), length=PASSAGE).withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))
    ).select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents and their pieces."""
    return packing.pack(packing.measured(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash_neardup", remove_near_duplicates),
    ("suffix_dedup", remove_repeated_strings),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: The toxicity model and the LSH forest are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
