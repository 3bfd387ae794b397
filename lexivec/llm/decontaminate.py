"""Benchmark decontamination: a prefix-filtered containment join of word windows, in DataFrame functions only.

An item gives one window per ten consecutive words (one shorter window if it has fewer words). The
words of a window are ordered by their frequency in the documents; a text that contains the window
contains its rarest word, so that word alone, the prefix, is joined with the words of the documents.
A prefix word at position ``p`` and offset ``o`` of the window puts the window at ``p - o``; the
window must begin and end inside the text (positional and length bounds), and the words there are
compared with all words of the window.

Three passes over the documents: frequencies of benchmark words, positions of prefix words, and
the comparison. Only positions of prefix words and the texts beside them are shuffled. Benchmark
tables are broadcast up to ``BROADCAST_ROWS`` rows, counted first; beyond that the same joins shuffle.

Defined results: a null text has no words; a null id is an id like any other; repeated rows give
repeated rows; an item without words has no window; items with a null id mark words but are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.scratch import Scratch

#: Words per window.
WINDOW = 10
#: Benchmark-side tables up to this many rows are broadcast; a row has one window of ten words at most.
BROADCAST_ROWS = 200_000

#: Maximal runs of letters, digits and characters beyond ASCII; A-Z is lowered afterwards.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in their own case; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """A-Z to a-z. Most words are lower case already, which one comparison tells."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, _UPPER, _LOWER))


def _hinted(table: DataFrame) -> tuple[DataFrame, bool]:
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(table) if small else table), small


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, words, win): the windows of every item; ``win`` joins the words with spaces."""
    words = items.select(F.col(item_id).alias("item_id"), F.transform(words_of(F.col(text)), lowered).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return (
        words.filter(F.size("all") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, window))).alias("words"))
        .withColumn("win", F.concat_ws(" ", "words"))
    )


def frequencies(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often each word of ``vocabulary(word)`` occurs in the documents."""
    vocabulary, small = _hinted(vocabulary)
    said = docs.select(F.explode(words_of(F.col(text))).alias("w")).select(lowered(F.col("w")).alias("word"))
    if small:
        return said.join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return said.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, win, len, offset): each different window under its rarest word that the documents have.

    A window with a word that no document has occurs nowhere and is left out.
    """
    spread = windows.select("win", "words").dropDuplicates(["win"]).select(
        "win", F.size("words").alias("len"), F.posexplode("words").alias("offset", "word")
    )
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")
    return (
        spread.join(counts, "word", "left")
        .groupBy("win", "len")
        .agg(F.min(rarity).alias("rarest"))
        .filter("rarest.n > 0")
        .select(F.col("rarest.word").alias("token"), "win", "len", F.col("rarest.offset").alias("offset"))
    )


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: doc_id, row (hash of the text), n_words, spans (hit ranges of words, merged), n_hit, items (sorted strings)."""
    windows = benchmark_windows(items, item_id, item_text, window)
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    kept = Scratch(docs.sparkSession, "decontaminate")  # the prefixes serve three joins; they are found once
    table = kept.write(prefixes(windows, frequencies(docs, text, vocabulary)), "prefixes")
    by_token, _ = _hinted(table)
    tokens, _ = _hinted(table.select("token").distinct())
    owners, _ = _hinted(windows.select("win", "item_id").distinct().join(table.select("win"), "win", "left_semi"))

    found = (
        docs.select(F.col(doc_id).alias("found_id"), F.xxhash64(text).alias("found_row"), F.posexplode(words_of(F.col(text))).alias("pos", "w"))
        .select("found_id", "found_row", "pos", lowered(F.col("w")).alias("token"))
        .join(tokens, "token", "left_semi")
        .groupBy("found_id", "found_row")
        .agg(F.collect_set(F.struct("pos", "token")).alias("found"))
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    reach = 2 * window - 1
    context = F.transform(
        "found",
        lambda f: F.struct(
            f.pos.alias("pos"), f.token.alias("token"),
            # One string a place: a list of words would take ten times the memory in a text full of prefix words.
            F.concat_ws(" ", F.transform(F.slice("words", F.greatest(f.pos - window + 2, F.lit(1)), reach), lowered)).alias("near"),
        ),
    )
    own_row = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("token"),
                               F.lit(None).cast("string").alias("near")))
    places = (
        texts.join(found, texts["doc_id"].eqNullSafe(found["found_id"]) & (texts["row"] == found["found_row"]), "left")
        .select("doc_id", "row", words_of(F.col("text")).alias("words"), "found")
        .select("doc_id", "row", F.size("words").alias("n_words"),
                F.explode(F.concat(own_row, F.coalesce(context, F.array().cast(_NEAR)))).alias("at"))
        .select("doc_id", "row", "n_words", "at.*")
    )
    start, first = F.col("pos") - F.col("offset"), F.greatest(F.col("pos") - window + 1, F.lit(0))
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    until = F.call_function("substring_index", F.col("near"), F.lit(" "), start - first + F.col("len"))  # no word has a space
    same = F.call_function("substring_index", until, F.lit(" "), -F.col("len")) == F.col("win")
    hits = (
        places.join(by_token, "token", "left")
        .withColumn("hit", F.coalesce(F.when(fits, same), F.lit(False)))
        .filter("hit or pos is null")
        .select("doc_id", "row", "n_words", F.col("pos").isNull().alias("own"), F.when(F.col("hit"), F.col("win")).alias("win"),
                F.when(F.col("hit"), F.struct(start.alias("start"), (start + F.col("len")).alias("end"))).alias("span"))
        .join(owners, "win", "left")
    )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1).end >= s.start),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1).start.alias("start"),
                                 F.greatest(F.element_at(done, -1).end, s.end).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return (
        hits.groupBy("doc_id", "row", "n_words")
        .agg(
            F.collect_set("span").alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"),
            F.count(F.when(F.col("own"), 1)).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(
            "doc_id", "row", F.col("n_words").cast("bigint").alias("n_words"), merged.alias("spans"),
            F.array_sort("items").alias("items"),
        )
        .withColumn(
            "n_hit",
            F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s.end - s.start).cast("bigint")),
        )
    )


_NEAR = "array<struct<pos:int,token:string,near:string>>"


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """The documents without a window of an item."""
    found = contamination(docs, items, doc_id, text, **columns).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias("k"), F.col("row").alias("r"))
    same = docs[doc_id].eqNullSafe(found["k"]) & (F.xxhash64(docs[text]) == found["r"])
    return docs.join(found, same, "left_anti")


def digest(result: DataFrame) -> DataFrame:
    """The result of ``contamination`` with a digest in place of the lists."""
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
