"""Word and symbol frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as tx
from lexivec.functions.chunks import SPACES, chunks_of, text_slices
from lexivec.sources.sizing import spread

COUNT_BYTES = 8 << 20  # of text that a task counts at a time


def chunk_counts(docs: DataFrame, text: str = "text", spaces: bool = True) -> DataFrame:
    """``(chunk, n)``: how often each chunk occurs, with or without the whitespace bytes; counted per task before the shuffle."""
    blank = [SPACES[k : k + 1] for k in range(len(SPACES))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(0), COUNT_BYTES):
                found = chunks_of(part)[0].value_counts()
                chunk, n = found.field("values").cast(pa.binary()), found.field("counts")
                if not spaces:
                    words = pc.invert(pc.is_in(chunk, pa.array(blank, pa.binary())))
                    chunk, n = chunk.filter(words), n.filter(words)
                yield pa.RecordBatch.from_arrays([chunk, n], ["chunk", "n"])

    found = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "chunk binary, n bigint")
    return found.groupBy("chunk").agg(F.sum("n").alias("n"))


def word_freq(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every whitespace token; counted map-side before the shuffle."""
    counts = chunk_counts(spread(docs.select(text)), text, spaces=False)
    return counts.select(F.col("chunk").cast("string").alias("word"), F.col("n").alias("freq"))


def symbol_freq(words: DataFrame) -> DataFrame:
    """Each distinct word as its byte symbols, carrying the word's frequency.

    Words and byte sequences map one to one, so no second aggregation is needed.
    """
    return words.select(tx.byte_chars(F.col("word")).alias("syms"), "freq")


def vocab_log(words: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most frequent words, ties in byte order."""
    return words.orderBy(F.desc("freq"), "word").limit(n)  # strings sort by their bytes


def counting_upsert(*vocabularies: DataFrame) -> DataFrame:
    """Add up vocabularies: new words enter, known words count up. One shuffle for any number."""
    rows = vocabularies[0].select("word", "freq")
    for other in vocabularies[1:]:
        rows = rows.unionByName(other.select("word", "freq"))
    return rows.groupBy("word").agg(F.sum("freq").alias("freq"))
