"""Removal of repeated lines or paragraphs by digests of their normalised text.

A unit is a line (or a paragraph, up to an empty line) with its line end. Its digest is of the text in
lower-case ASCII letters with single spaces. Of all units with one digest the earliest stays: by rank, then
id, then place; the others are removed, and their byte ranges in the original text are kept in the result.

Digests are counted with partial sums, and only those that occur again are joined with their units. The rows of
one digest are dealt over ``SALTS`` tasks, which all get its first place, so that a line that a third of all
documents share is not one task's work. Defined results: a null text is empty;
empty units stay; equal rows of one id are one occurrence and stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import slices, text_bytes
from lexivec.scratch import Scratch

#: Tasks that share the units of one digest.
SALTS = 32


def unit_bounds(text: bytes, paragraphs: bool = False) -> list[int]:
    """Offsets where units begin, and the end; line ends belong to the unit before them."""
    out, at = [0], 0
    mark = b"\n\n" if paragraphs else b"\n"
    while (at := text.find(mark, at)) >= 0:
        at += len(mark)
        if paragraphs:
            while text[at : at + 1] == b"\n":
                at += 1
        if at < len(text):
            out.append(at)
    return [*out, len(text)] if text else [0]


def _units(paragraphs: bool, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(offsets):
                rows, begins, ends, digests = [], [], [], []
                for row in range(lo, hi):
                    text = data[offsets[row] : offsets[row + 1]].tobytes()
                    bounds = unit_bounds(text, paragraphs)
                    for a, b in zip(bounds, bounds[1:], strict=False):
                        words = text[a:b].lower().split()
                        if len(words) >= least:
                            rows.append(row)
                            begins.append(a)
                            ends.append(b)
                            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in (0, 1, 3)), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()),
                     pa.array(digests, pa.binary())],
                    ["doc_id", "row", "rank", "begin", "end", "digest"],
                )

    return run


def _remover(paragraphs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spans = batch.column(2).to_pylist()
            kept, counts = [], []
            for row in range(len(batch)):
                text = data[offsets[row] : offsets[row + 1]]
                counts.append(len(unit_bounds(text.tobytes(), paragraphs)) - 1)
                gone = np.zeros(len(text), bool)
                for span in spans[row] or ():
                    gone[span["begin"] : span["end"]] = True
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()), batch.column(2)],
                ["doc_id", "n_units", "kept", "spans"],
            )

    return run


def remove_repeated_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rank: Column | None = None, paragraphs: bool = False,
    least: int = 1,
) -> DataFrame:
    """(doc_id, n_units, kept, spans): the remaining text of every row and the ranges of its removed units.

    ``rank`` (a number, least first) orders the documents before their id does. Units of fewer than ``least``
    words stay; 1 removes every repeated unit that is not empty.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "lines")
    ranked = (F.lit(0) if rank is None else rank).cast("double").alias("rank")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"), ranked)
    units = scratch.write(
        texts.mapInArrow(_units(paragraphs, least), f"doc_id {kind}, row bigint, rank double, begin int, end int, digest binary"),
        "units",
    )
    place = F.struct("rank", "doc_id", "row", "begin")
    again = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = units.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "begin"), F.lit(SALTS)).cast("int"))
    removed = (
        salted.join(again, ["digest", "salt"]).filter(place != F.col("first"))
        .groupBy(F.col("doc_id").alias("k"), F.col("row").alias("r"))
        .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    )
    removed = scratch.finish(removed)
    same = texts["doc_id"].eqNullSafe(removed["k"]) & (texts["row"] == removed["r"])
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>"))
    return texts.join(removed, same, "left").select("doc_id", "text", spans.alias("spans")).mapInArrow(
        _remover(paragraphs), f"doc_id {kind}, n_units bigint, kept binary, spans array<struct<begin:int,end:int>>"
    )


def digest(result: DataFrame) -> DataFrame:
    """The result of ``remove_repeated_units`` with the remaining text, its digest and the removed ranges as ``begin-end``."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.begin)
    ranges = F.transform("spans", lambda s: F.concat_ws("-", s.begin.cast("string"), s.end.cast("string")))
    return result.select(
        "doc_id", "n_units", F.size("spans").cast("bigint").alias("n_removed"), removed.alias("bytes_removed"),
        F.sha2("kept", 256).alias("kept_sha256"), F.array_join(ranges, ",").alias("spans"), F.col("kept").cast("string").alias("text"),
    )
