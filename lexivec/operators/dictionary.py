"""Encoding by a dictionary: every distinct chunk of the corpus is merged once for the whole cluster.

``codec.encode_corpus`` merges a distinct chunk once per task. Here the chunks (runs without whitespace, and single
whitespace bytes) are counted first, each is merged once, and the results go back to the texts in two ways: the
most frequent ones, a fixed number, go to every task; the others are joined, where by that choice no chunk is
hot. Each text is shuffled once, to the entries of its rare chunks, and ids are made after that. It pays where merging is
the cost, with many merges or long chunks; for few merges the narrow form is faster.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.chunks import chunks_of, spelled_out, text_slices
from lexivec.functions.greedy import GreedyEncoder
from lexivec.operators import codec
from lexivec.operators.vocab import chunk_counts
from lexivec.scratch import Scratch
from lexivec.sources.sizing import spread

HOT = 1 << 16  # chunks that go to every task
HOT_BYTES = 64  # and their longest


def _lists(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def chunk_dictionary(counts: DataFrame, tokenizer: DataFrame) -> DataFrame:
    """``(chunk, n, ids)``: every chunk with its token ids."""
    shared, unknown = codec.shared_tokens(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy = GreedyEncoder(shared.value, unknown)
        for batch in batches:
            ids = _lists([array("i", greedy.merge(c)).tobytes() for c in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["chunk", "n", "ids"])

    return counts.select("chunk", "n").mapInArrow(encode, "chunk binary, n bigint, ids array<int>")


def _asking(hot: dict[bytes, bytes]):
    """``(key, chunk)``: the distinct chunks of every text that are not in ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1), codec.SLICE_BYTES):
                chunks, bounds = chunks_of(texts)
                chunks = chunks.dictionary_encode()
                rare = np.array([c not in hot for c in chunks.dictionary.to_pylist()], bool)
                which = chunks.indices.to_numpy()
                asked = np.flatnonzero(rare[which])
                row = np.searchsorted(bounds, asked, "right") - 1
                own = np.unique(row * len(rare) + which[asked])
                row, chunk = np.divmod(own, max(1, len(rare)))
                keys = batch.column(0).take(pa.array(at + row))
                yield pa.RecordBatch.from_arrays([keys, chunks.dictionary.take(pa.array(chunk)).cast(pa.binary())], ["key", "chunk"])
                at += len(texts)

    return run


def _encoding(hot: dict[bytes, bytes]):
    """Texts to ids by ``hot`` and the entries in the last column, which hold the rows' other chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kept = 0, batch.num_columns - 2
            for texts in text_slices(batch.column(kept), codec.SLICE_BYTES):
                others = [c.slice(at, len(texts)) for c in batch.columns[:kept]]
                found = batch.column(kept + 1).slice(at, len(texts)).flatten()
                lists = found.field("ids")
                ends = np.cumsum([0, *lists.value_lengths().to_numpy()]) * 4
                packed = lists.flatten().to_numpy().tobytes()
                own = {c: packed[x:y] for c, x, y in zip(found.field("chunk").to_pylist(), ends, ends[1:])}
                chunks, bounds = chunks_of(texts)
                chunks = chunks.dictionary_encode()
                coded = [own[c] if (known := hot.get(c)) is None else known for c in chunks.dictionary.to_pylist()]
                ids, begins = spelled_out(chunks.indices.to_numpy(), coded, bounds)
                missing = pa.array(np.asarray(texts.is_null().to_numpy(zero_copy_only=False)))
                ids = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids), mask=missing)
                yield pa.RecordBatch.from_arrays([*others, ids], [*batch.schema.names[:kept], "ids"])
                at += len(texts)

    return run


def encode_by_dictionary(docs: DataFrame, tokenizer: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``codec.encode_corpus``, in which every distinct chunk was merged once.

    Where a ranked token spans whitespace chunks do not stand alone, and the narrow form is taken.
    """
    # A ranked token stands within a chunk if it has no whitespace byte, or is one; tokens are in hex.
    crossing = F.col("rank").isNotNull() & (F.length("token") > 2) & F.rlike("token", F.lit("^(?:..)*(?:20|0[9A-D])"))
    if not tokenizer.filter(crossing).isEmpty():
        return codec.encode_corpus(docs, tokenizer, text)
    scratch = Scratch(docs.sparkSession, "dictionary")
    docs = spread(docs)
    table = scratch.write(chunk_dictionary(chunk_counts(docs, text), tokenizer), "chunks")
    first = table.filter(F.octet_length("chunk") <= HOT_BYTES).orderBy(F.desc("n"), "chunk").limit(hot).toArrow()
    chosen = dict(zip(first.column("chunk").to_pylist(), (np.array(i, np.int32).tobytes() for i in first.column("ids").to_pylist()), strict=True))
    kept = [c for c in docs.columns if c != text]
    shape = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType()))
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _asking(shared.value)(batches)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoding(shared.value)(batches)

    # Texts of one key get each other's entries as well, which are the same for all texts.
    texts = docs.select(*kept, F.col(text).cast("binary").alias("_text"), F.xxhash64(F.col(text).cast("binary")).alias("_key"))
    asked = texts.select("_key", "_text").mapInArrow(ask, "key bigint, chunk binary")
    found = asked.join(table.select("chunk", "ids"), "chunk").groupBy("key").agg(
        F.collect_set(F.struct("chunk", "ids")).alias("_found")
    )
    none = F.array().cast("array<struct<chunk:binary,ids:array<int>>>")
    rows = texts.join(found, texts["_key"] == found["key"], "left").select(*kept, "_text", F.coalesce("_found", none).alias("_found"))
    return rows.mapInArrow(encode, shape)
