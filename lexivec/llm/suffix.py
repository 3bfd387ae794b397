"""Removal of long byte strings that occur more than once, by run-length indexes of the repetitive parts.

Every window of ``length`` bytes is named by the least hash of its grams of ``GRAM`` bytes. Equal windows
have equal names, and neighbouring windows mostly share theirs, so a document becomes about one segment
per half window: the windows of one name in a row, with the bytes they cover. What follows is decided
within a name, and a name is decided in one of these ways:

* a single segment without a repeated gram: nothing in it occurs again;
* equal segments only: all their windows occur again. No bytes are moved for either;
* several different segments: one copy of each goes, with the others of its name, into an index shard of
  about ``SHARD`` bytes. The shard builds its run-compressed Burrows-Wheeler transform with sampled run
  ends and streams the matching statistics; windows whose longest match elsewhere has ``length`` bytes
  or more occur again;
* a name with more than ``HOT`` bytes of different segments (a passage that a large share of all
  documents has, in ever new surroundings) would not fit a shard: its windows are counted by 128-bit
  fingerprints instead, spread over all tasks.

Removed are all bytes of windows that occur again. Strings are judged on the input only.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; repeated rows are
documents of their own and repeat each other; null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import SLICE, _power_tables, binary_column, gather_spans, mix, slices, text_bytes
from lexivec.llm.runindex import RunIndex, runs_of
from lexivec.scratch import Scratch

#: Bytes of a string that must not occur twice.
LENGTH = 400
#: Bytes of the grams that name a window.
GRAM = 32
#: Bytes of an index shard on average, and of one name at most.
SHARD, HOT = 3 << 19, 4 << 20
#: Windows of one segment at most; longer stretches under one name are cut.
STRETCH = 1 << 16


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from every position on."""
    forward, backward = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:n]) * backward[:n])


def _extreme(values: np.ndarray, width: int, pick: np.ufunc, beyond: np.uint64) -> np.ndarray:
    """``pick`` over ``width`` values from every position on, in two passes over blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, beyond, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = pick.accumulate(grid, axis=1).reshape(-1)
    m = n - width + 1
    return pick(ahead[:m], behind[width - 1 : width - 1 + m])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of the texts: row, first window, window after the last, name, repeats its gram."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return {"row": empty, "begin": empty, "end": empty, "name": empty.astype(np.uint64), "again": empty.astype(bool)}
    grams, span = _rolled(data, gram), length - gram + 1
    name = _extreme(grams, span, np.minimum, np.uint64(2**64 - 1))  # per window of the whole slice
    inside = np.zeros(len(data) + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(inside[:-1])[: len(name)] > 0
    fresh = np.ones(len(name), bool)
    fresh[1:] = name[1:] != name[:-1]
    starts = offsets[:-1][long]
    fresh[starts] = True
    begins = np.flatnonzero(fresh & inside)
    # A segment ends where the next one begins or its text has no further window.
    row = np.searchsorted(offsets, begins, "right") - 1
    ends = np.minimum(np.append(begins[1:], len(name)), offsets[row + 1] - length + 1)
    # Grams that name some window: the greatest name among the windows around them is their own hash.
    around = np.full(len(grams) + span - 1, 0, np.uint64)
    around[span - 1 : span - 1 + len(name)] = np.where(inside, name, 0)
    named = np.flatnonzero(_extreme(around, span, np.maximum, np.uint64(0))[: len(grams)] == grams)
    lo = np.searchsorted(named, begins)
    hi = np.searchsorted(named, ends + length - gram)
    which = np.repeat(np.arange(len(begins)), hi - lo)
    at = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    own = grams[named[at]] == name[begins[which]]
    again = np.bincount(which[own], minlength=len(begins)) > 1
    return {"row": row, "begin": begins, "end": ends, "name": name[begins], "again": again}


def _segmenter(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                text, start = data[part[0] : part[-1]], part - part[0]
                found = segments(text, start, length, gram)
                if len(found["row"]) == 0:
                    continue
                pieces = -(-(found["end"] - found["begin"]) // STRETCH)
                if pieces.max(initial=1) > 1:  # cut long stretches; their pieces keep the name
                    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    found = {k: np.repeat(v, pieces) for k, v in found.items()}
                    found["begin"] = found["begin"] + step * STRETCH
                    found["end"] = np.minimum(found["end"], found["begin"] + STRETCH)
                    found["again"] |= np.repeat(pieces, pieces) > 1
                view = memoryview(np.ascontiguousarray(text))
                body = [
                    xxhash.xxh3_64_intdigest(view[a:b])
                    for a, b in zip(found["begin"].tolist(), (found["end"] + length - 1).tolist(), strict=True)
                ]
                base = start[found["row"]]
                rows = pa.array(found["row"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array((found["begin"] - base).astype(np.int32)), pa.array((found["end"] - base).astype(np.int32)),
                     pa.array(found["name"].view(np.int64)), pa.array(np.array(body, np.uint64).view(np.int64)),
                     pa.array(found["again"])],
                    ["doc_id", "row", "begin", "end", "name", "body", "again"],
                )

    return run


def _cutter(length: int):
    """The bytes of the wanted segments of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            wanted = batch.column(3)
            parent = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            begin, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("begin", "end"))
            begin, end = begin + offsets[parent], end + offsets[parent] + length - 1
            for lo, hi in slices(np.concatenate([[0], np.cumsum(end - begin)])):
                body, at = gather_spans(data, begin[lo:hi], end[lo:hi])
                rows = pa.array(parent[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     *(flat.field(k).slice(lo, hi - lo) for k in ("begin", "name", "copies")), binary_column(body, at)],
                    ["doc_id", "row", "begin", "name", "copies", "body"],
                )

    return run


def _indexer(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Windows of a shard that occur again, as ranges of window starts of their document."""
        table = table.combine_chunks()
        data, offsets = text_bytes(table.column("body"))
        again = RunIndex.build(data, offsets).matches() >= length
        lo, hi = runs_of(again)
        # A run of windows stays within its segment: the last bytes of a segment begin no window.
        row = np.searchsorted(offsets, lo, "right") - 1
        base = table.column("begin").to_numpy()[row] - offsets[row]
        rows = pa.array(row)
        return pa.table(
            {"doc_id": table.column("doc_id").take(rows), "row": table.column("row").take(rows),
             "begin": pa.array((lo + base).astype(np.int32)), "end": pa.array((hi + base).astype(np.int32))}
        )

    return run


def _printer(length: int):
    """A row per window with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for lo, hi in slices(offsets, SLICE // 8):
                part = offsets[lo : hi + 1]
                text, sizes = data[part[0] : part[-1]], np.diff(part) - length + 1
                row = np.repeat(np.arange(hi - lo), sizes)
                step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = part[row] - part[0] + step
                one = _rolled(text, length)[at]
                two = _rolled(text[::-1], length)[len(text) - length - at]
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array((batch.column(2).to_numpy()[row + lo] + step).astype(np.int32)),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["doc_id", "row", "begin", "one", "two"],
                )

    return run


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    shard: int = SHARD, hot: int = HOT,
) -> DataFrame:
    """(doc_id, row, spans): byte ranges of each document, unmerged, that repeated strings cover.

    ``row`` is the hash of the text; documents without repeats are absent.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    at = f"doc_id {kind}, row bigint, begin int, end int"
    found = scratch.write(texts.mapInArrow(_segmenter(length, gram), f"{at}, name bigint, body bigint, again boolean"), "segments")
    names = (
        found.groupBy("name")
        .agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"), F.max("again").alias("again"))
        .filter("n > 1 or again")
        .select("name", (F.col("again") | (F.col("low") != F.col("high"))).alias("mixed"))
    )
    found = scratch.write(found.join(names, "name"), "named")
    scratch.drop("segments")
    mixed = found.filter("mixed")
    place = F.struct("doc_id", "row", "begin", "end").alias("at")
    bodies = scratch.write(mixed.groupBy("name", "body").agg(F.count("*").alias("copies"), F.min(place).alias("at")), "bodies")
    size = F.col("at.end") - F.col("at.begin") + (length - 1)
    sizes = bodies.groupBy("name").agg(F.sum(size).alias("size"))
    total = sizes.filter(F.col("size") <= hot).agg(F.sum("size")).first()[0] or 0
    shards = int(total // shard) + 1
    wanted = (
        bodies.join(sizes, "name")
        .select("at.doc_id", "at.row", F.struct(
            F.col("at.begin").alias("begin"), F.col("at.end").alias("end"), "name",
            F.when(F.col("size") <= hot, F.pmod(F.xxhash64("name"), F.lit(shards))).otherwise(-1).cast("int").alias("copies"),
        ).alias("cut"))
        .groupBy(F.col("doc_id").alias("k"), F.col("row").alias("r"))
        .agg(F.collect_list("cut").alias("cuts"))
    )
    same = texts["doc_id"].eqNullSafe(wanted["k"]) & (texts["row"] == wanted["r"])
    cut = texts.join(wanted, same).select("doc_id", "row", "text", "cuts").mapInArrow(
        _cutter(length), f"doc_id {kind}, row bigint, begin int, name bigint, copies int, body binary"
    )
    # Equal rows of one id cut the same bytes; one copy is what the index holds.
    cut = scratch.write(cut.withColumnRenamed("copies", "shard"), "cuts")
    cool = cut.filter("shard >= 0").groupBy("shard").applyInArrow(_indexer(length), at)
    parts = [
        found.filter("not mixed").select("doc_id", "row", "begin", "end"),
        mixed.join(bodies.filter("copies > 1").select("name", "body"), ["name", "body"]).select("doc_id", "row", "begin", "end"),
        cool,
    ]
    if not cut.filter("shard < 0").isEmpty():
        prints = cut.filter("shard < 0").select("doc_id", "row", "begin", "body").mapInArrow(
            _printer(length), f"doc_id {kind}, row bigint, begin int, one bigint, two bigint"
        )
        twice = prints.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        parts.append(prints.join(twice, ["one", "two"]).select("doc_id", "row", "begin", (F.col("begin") + 1).alias("end")))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    span = F.struct(F.col("begin"), (F.col("end") + (length - 1)).alias("end"))
    return scratch.finish(spans.groupBy("doc_id", "row").agg(F.collect_set(span).alias("spans")), "spans")


def _without(data: np.ndarray, begin: np.ndarray, end: np.ndarray, characters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of a text without the ranges, and the merged ranges."""
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover[:-1]) > 0
    if characters:  # a character goes only as a whole
        lead = np.cumsum((data & 0xC0) != 0x80)
        whole = np.ones(int(lead[-1]) + 1 if len(lead) else 1, bool)
        whole[lead[~gone]] = False
        gone &= whole[lead]
    return data[~gone], *runs_of(gone)


def _ranges(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the rows of a list column of ranges, and the ranges."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy()
    flat = spans.flatten()
    begin, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("begin", "end"))
    return np.concatenate([[0], np.cumsum(sizes)]), begin, end


def _remover(characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            bounds, begin, end = _ranges(batch.column(2))
            for lo, hi in slices(offsets):
                kept, merged = [], []
                for row in range(lo, hi):
                    body, part = data[offsets[row] : offsets[row + 1]], slice(bounds[row], bounds[row + 1])
                    if part.start == part.stop:
                        kept.append(body.tobytes())
                        merged.append([])
                        continue
                    body, first, last = _without(body, begin[part], end[part], characters)
                    kept.append(body.tobytes())
                    merged.append([{"begin": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(kept, pa.binary()),
                     pa.array(merged, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                    ["doc_id", "n_bytes", "kept", "spans"],
                )

    return run


def _text_cutter(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text, at ``place``, loses its ranges; the ranges are the last column."""
        for batch in batches:
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            data, offsets = text_bytes(columns[place])
            bounds, begin, end = _ranges(batch.column(len(columns)))
            for lo, hi in slices(offsets):
                out = columns[place].slice(lo, hi - lo).to_pylist()
                for row in range(lo, hi):
                    part = slice(bounds[row], bounds[row + 1])
                    if part.start < part.stop:
                        body = data[offsets[row] : offsets[row + 1]]
                        out[row - lo] = _without(body, begin[part], end[part], True)[0].tobytes().decode()
                parts = [c.slice(lo, hi - lo) for c in columns]
                parts[place] = pa.array(out, columns[place].type)
                yield pa.RecordBatch.from_arrays(parts, names)

    return run


def cut_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **limits) -> DataFrame:
    """``docs`` with every text cut; a character goes only if all of its bytes do, so texts stay valid."""
    spans = repeated_spans(docs, doc_id, text, length, **limits).select(F.col("doc_id").alias("k"), F.col("row").alias("r"), "spans")
    same = docs[doc_id].eqNullSafe(spans["k"]) & (F.xxhash64(docs[text]) == spans["r"])
    own = "spans"
    while own in docs.columns:  # columns of the table keep their names
        own += "_"
    rows = docs.join(spans, same, "left").select(*(docs[c] for c in docs.columns), spans["spans"].alias(own))
    return rows.mapInArrow(_text_cutter(docs.columns.index(text)), docs.schema)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, characters: bool = False, **limits
) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): the remaining bytes of every row and its maximal removed ranges.

    With ``characters`` a character is removed only if all of its bytes are.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    spans = repeated_spans(docs, doc_id, text, length, **limits).select(F.col("doc_id").alias("k"), F.col("row").alias("r"), "spans")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    same = texts["doc_id"].eqNullSafe(spans["k"]) & (texts["row"] == spans["r"])
    return texts.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(
        _remover(characters),
        f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<begin:int,end:int>>",
    )


def digest(result: DataFrame) -> DataFrame:
    """The result of ``remove_repeats`` with a digest of the remaining bytes, and these as a text.

    Cuts are at bytes: what is left of a character that was cut through becomes replacement characters in ``text``.
    """
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.begin)
    return result.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
