"""Encoding and decoding whole corpora with a tokenizer table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.greedy import TextEncoder
from lexivec.operators.blocks import BROADCAST_CELLS
from lexivec.operators.keyed import lookup
from lexivec.sources.sizing import spread

BROADCAST_TOKENS = 2_000_000  # above any table of this package: merges are limited by their symbols
INLINE_TOKENS = 100_000  # the most tokens a decode plan carries as a constant
BOS, EOS, UNKNOWN = 0, 1, "<|unk|>"
SLICE_BYTES = 1 << 20  # of text that a task encodes at a time
DECODE_SEGMENT = 4096  # ids of a row that one list holds
_ENCODERS: dict[str, TextEncoder] = {}  # per Python worker: the encoder last used


def _bounded(tokenizer: DataFrame, limit: int) -> list | None:
    rows = tokenizer.select("id", "token", "rank").limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def shared_tokens(tokenizer: DataFrame) -> tuple[Broadcast, bytes | None]:
    """The token table, whose size is checked, for every task, and its token for unknown bytes."""
    rows = _bounded(tokenizer, BROADCAST_TOKENS)
    if rows is None:
        raise ValueError(f"the token table exceeds {BROADCAST_TOKENS} rows")
    tokens = [(r["id"], bytes.fromhex(r["token"]), r["rank"]) for r in rows]
    unknown = UNKNOWN.encode() if any(t == UNKNOWN.encode() for _, t, _ in tokens) else None
    return tokenizer.sparkSession.sparkContext.broadcast(tokens), unknown


def _slices(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """The texts in parts of about ``size`` bytes, a longer one by itself: ids take four times the room of their text."""
    size = size or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        begin = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def encoder(tokenizer: DataFrame) -> Callable[[Column], Column]:
    """A column function from text to token ids.

    The bytes of the text are read as they are, up to the first NUL. A byte that no token covers takes
    the id of the unknown token, or -1 when the table has none.

    Encoding is narrow: the token table, whose size is checked, goes to every task once, and
    texts are never exploded or shuffled. A task holds the ids of a few texts at a time, whatever Spark's batches hold.
    """
    shared, unknown = shared_tokens(tokenizer)
    name = uuid.uuid4().hex

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _ENCODERS.get(name)
        if coder is None:
            _ENCODERS.clear()
            coder = _ENCODERS[name] = TextEncoder(shared.value, unknown)
        for texts in batches:
            for part in _slices(texts):
                yield coder.lists(part)

    ids = F.arrow_udf(encode, "array<int>")
    return lambda text: ids(text.cast("binary"))


def encode_corpus(docs: DataFrame, tokenizer: DataFrame, text: str = "text") -> DataFrame:
    """Documents with their token ids in ``ids``; the text itself is not carried along."""
    kept = [c for c in docs.columns if c != text]
    return spread(docs).select(*kept, encoder(tokenizer)(F.col(text)).alias("ids"))


def with_bos_eos(encoded: DataFrame, bos: bool = True, eos: bool = True) -> DataFrame:
    """Put the begin token in front and the end token behind, as asked."""
    none = F.array().cast("array<int>")
    front = F.array(F.lit(BOS)) if bos else none
    back = F.array(F.lit(EOS)) if eos else none
    return encoded.withColumn("ids", F.concat(front, F.col("ids"), back))


def decode_corpus(
    encoded: DataFrame, tokenizer: DataFrame, key: list[str], inline_tokens: int = INLINE_TOKENS
) -> DataFrame:
    """Token ids back to text, as the hex of the bytes.

    One row per row of ``encoded``; an id that the table does not hold, or an empty sequence, gives
    NULL. A table of checked size becomes a constant of the plan and decoding is a projection; beyond
    that, ids are joined, with the same result.
    """
    rows = _bounded(tokenizer, inline_tokens)
    top = max((r["id"] for r in rows or ()), default=-1)
    if rows is None or top >= 2 * inline_tokens:
        return _decode_by_join(encoded, tokenizer, key)
    table = [""] * (top + 1)  # an id in a gap has no bytes
    for r in rows:
        table[r["id"]] = r["token"]
    lookup = F.split(F.lit(",".join(table)), ",")
    bad = F.exists("ids", lambda i: i.isNull() | (i < 0) | (i > top) | (F.get(lookup, i) == ""))
    spelled = F.array_join(F.transform("ids", lambda i: F.get(lookup, i)), "")
    return encoded.select(*key, F.when((F.size("ids") > 0) & ~bad, spelled).alias("decoded"))


def _decode_by_join(encoded: DataFrame, tokenizer: DataFrame, key: list[str]) -> DataFrame:
    """Ids go by segments of a row, so a long row is put together from short sorted lists."""
    rows = encoded.select(*key, "ids").withColumn("_row", F.monotonically_increasing_id())
    spread_ids = rows.select(*key, "_row", F.posexplode_outer("ids").alias("pos", "_id"))
    named = lookup(spread_ids, tokenizer.select(F.col("id").alias("_id"), "token"), "_id")
    segment = F.floor(F.coalesce("pos", F.lit(0)) / DECODE_SEGMENT).alias("_segment")

    def joined(order: str, text: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(parts, lambda p: p[text]), "").alias("text")

    bad = F.max(F.col("token").isNull()).alias("bad")
    parts = named.groupBy(*key, "_row", segment).agg(bad, joined("pos", "token"))
    whole = parts.groupBy(*key, "_row").agg(F.max("bad").alias("bad"), joined("_segment", "text"))
    return whole.select(*key, F.when(~F.col("bad"), F.col("text")).alias("decoded"))


def _shared(table: DataFrame, size: Column, most: int) -> DataFrame:
    """A table of checked size goes to every task: dealt by id, all tokens of a corpus would be shuffled to few ids."""
    total = table.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= most else table


def token_listing(encoded: DataFrame, tokenizer: DataFrame, by: str) -> DataFrame:
    """How often each token occurs per group, named after counting.

    The outer explode keeps the optimizer from filtering on the ids first, which would encode twice.
    """
    counts = (
        encoded.select(by, F.explode_outer("ids").alias("id"))
        .filter("id is not null")
        .groupBy(by, "id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(tokenizer.select("id", "token"), "id").select(by, "id", "token", "n")


def token_sequences(encoded: DataFrame, tokenizer: DataFrame, key: list[str]) -> DataFrame:
    """Every token of every sequence: ``(key, pos, id, token)``; an id without a token has NULL."""
    rows = encoded.select(*key, F.posexplode_outer("ids").alias("pos", "id")).filter("id is not null")
    table = _shared(tokenizer.select("id", "token"), F.lit(1), INLINE_TOKENS)
    return lookup(rows, table, "id").select(*key, "pos", "id", "token")


def next_token_pairs(encoded: DataFrame) -> DataFrame:
    """Training pairs: how often each token is followed by each other token in a document."""
    ids = F.col("ids")
    width = F.greatest(F.size(ids) - 1, F.lit(0))
    rows = encoded.select(
        F.inline(F.arrays_zip(F.slice(ids, F.lit(1), width).alias("id"), F.slice(ids, F.lit(2), width).alias("next_id")))
    )
    return rows.groupBy("id", "next_id").agg(F.count(F.lit(1)).alias("n"))


def embedding_lookup(encoded: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows of an embedding table ``(id, vec)`` in token order: ``(key, pos, id, vec)``."""
    rows = encoded.select(*key, F.posexplode_outer("ids").alias("pos", "id")).filter("id is not null")
    table = _shared(table.select("id", "vec"), F.greatest(F.size("vec"), F.lit(1)), BROADCAST_CELLS)
    return lookup(rows, table, "id").select(*key, "pos", "id", "vec")
