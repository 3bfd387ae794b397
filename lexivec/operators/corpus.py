"""Projections and counts over a corpus of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as tx
from lexivec.sources.sizing import spread


def corpus_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with something to read: cut at the first NUL, empty texts dropped."""
    return docs.withColumn(text, tx.before_nul(F.col(text))).filter(F.length(text) > 0)


def byte_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every byte value.

    Each task counts whole Arrow buffers, so at most 256 rows per task are shuffled
    instead of one row per byte.
    """

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            _, ends, data = column.buffers()
            width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
            ends = np.frombuffer(ends, dtype=width)[column.offset : column.offset + len(column) + 1]
            if data is not None and len(ends):
                used = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
                total += np.bincount(used, minlength=256)
        present = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"byte": pa.array(present, pa.int32()), "n": pa.array(total[present], pa.int64())}
        )

    raw = docs.select(tx.before_nul(F.col(text)).cast("binary").alias("raw"))
    partial = spread(raw).mapInArrow(count_bytes, "byte int, n bigint")
    return partial.groupBy("byte").agg(F.sum("n").alias("n"))


def word_rows(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per whitespace token."""
    fields = F.explode(tx.fields_by_whitespace(F.col(text))).alias("word")
    return spread(docs.select(*keep, text)).select(*keep, fields).filter(F.col("word") != "")


def field_counts(docs: DataFrame, column: str, delimiter: str) -> DataFrame:
    """How often each literal-delimited field stands at each position."""
    parts = docs.select(
        F.posexplode(tx.delimited_fields(F.col(column), delimiter)).alias("pos", "field")
    )
    return parts.groupBy("pos", "field").agg(F.count(F.lit(1)).alias("n"))


def match_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Occurrences of every non-empty regular-expression match."""
    found = docs.select(F.explode(tx.regex_matches(F.col(text), pattern)).alias("match"))
    return found.groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def prefix_histogram(words: DataFrame, n: int, word: str = "word", freq: Column | None = None) -> DataFrame:
    """Weighted count of the first ``n`` bytes; shorter words fall under NULL."""
    weight = F.lit(1) if freq is None else freq
    return words.groupBy(tx.byte_prefix(F.col(word), n).alias("prefix")).agg(
        F.sum(weight).cast("bigint").alias("n")
    )


def alphabet_coverage(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Bytes before the first NUL inside and outside the base alphabet per group, without a row per byte."""
    read = tx.before_nul(F.col(text))
    kept = docs.select(
        by,
        F.octet_length(read).cast("bigint").alias("size"),
        F.octet_length(tx.unprintable_removed(read)).cast("bigint").alias("known"),
    )
    return (
        kept.groupBy(by)
        .agg(F.sum("size").alias("n_bytes"), F.sum(F.col("size") - F.col("known")).alias("n_unknown"))
        .withColumn("unknown_share", F.col("n_unknown") / F.col("n_bytes"))
    )


def path_rollup(table: DataFrame, path: str) -> DataFrame:
    """Entries, distinct base names and depth per directory."""
    parts = table.select(
        tx.path_dirname(F.col(path)).alias("dirname"),
        tx.path_basename(F.col(path)).alias("basename"),
        F.size(tx.path_parts(F.col(path))).alias("depth"),
    )
    per_name = parts.groupBy("dirname", "basename").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth")
    )
    return per_name.groupBy("dirname").agg(
        F.sum("n").alias("n_paths"),
        F.count(F.lit(1)).alias("n_basenames"),
        F.max("depth").alias("max_depth"),
    )
