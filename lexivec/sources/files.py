"""Plain-text corpora and directory inventories."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text as tx
from lexivec.operators.corpus import corpus_scan


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(path, text)``, one row per file; empty files are left out."""
    files = spark.read.text(path, wholetext=True)
    return corpus_scan(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Regular files directly in a directory: ``(dirname, basename, size)``; contents are not read.

    A scan skips files without bytes, so the names come from the file index of the same source. Names that
    begin with ``_`` or ``.`` are left out, as in every scan of files.
    """
    files = spark.read.format("binaryFile").load(directory)
    names = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string")
    base = tx.path_basename(F.col("path")).alias("basename")
    sizes = names.select("path", base).join(files.select(base, "length"), "basename", "left")
    return sizes.select(
        tx.path_dirname(F.col("path")).alias("dirname"),
        "basename",
        F.coalesce("length", F.lit(0)).cast("bigint").alias("size"),
    )


def list_dirs(spark: SparkSession, directory: str) -> DataFrame:
    """Directories directly in a directory that hold a file at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    below = F.substring_index(F.col("path"), directory.rstrip("/") + "/", -1)
    return files.filter(F.instr(below, "/") > 0).select(F.substring_index(below, "/", 1).alias("name")).distinct()


def inventory(spark: SparkSession, directory: str) -> DataFrame:
    """Files and bytes per directory."""
    return (
        list_files(spark, directory)
        .groupBy("dirname")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
    )
