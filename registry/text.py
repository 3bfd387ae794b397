"""Sources and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as tx
from lexivec.operators import corpus, vocab
from lexivec.scratch import Scratch
from lexivec.sources import tables
from registry.common import SPLIT_SQL, q6, r6, table, words_sql

NUMBER = "[0-9]+(?:[.,][0-9]+)*"


def corpus_scan(spark, sf):
    docs = corpus.corpus_scan(table(spark, sf, "documents"))
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"))


def path_rollup(spark, sf):
    out = corpus.path_rollup(table(spark, sf, "pages"), "url")
    return out.select("dirname", "n_paths", "n_basenames", F.col("max_depth").cast("bigint").alias("max_depth"))


def path_join(spark, sf):
    """Directory and base name of every address, taken apart and joined again, and a name below it."""
    url = F.col("url")
    whole = tx.path_join(tx.path_dirname(url), tx.path_basename(url))
    return table(spark, sf, "pages").select(
        "page_id", whole.alias("whole"), tx.path_join(url, F.lit("index.html")).alias("below")
    )


def vocab_table(spark, sf):
    path = Scratch(spark, "vocab").path("table")
    tables.save_table(vocab.word_freq(table(spark, sf, "documents")), path, "vocab")
    return tables.load_table(spark, path, "vocab")


def vocab_versions(spark, sf):
    """Two saves of a vocabulary; the first stays readable by its version when the second is the newest."""
    path = Scratch(spark, "vocab").path("versions")
    first = vocab.word_freq(table(spark, sf, "documents"))
    tables.save_table(first, path, "vocab")
    more = vocab.word_freq(table(spark, sf, "conversations"))
    tables.save_table(vocab.counting_upsert(tables.load_table(spark, path, "vocab"), more), path, "vocab")
    old = tables.load_table(spark, path, "vocab", version=1).select("word", F.col("freq").alias("old_freq"))
    return tables.load_table(spark, path, "vocab").join(old, "word", "left").select(
        "word", "freq", F.coalesce("old_freq", F.lit(0).cast("bigint")).alias("old_freq")
    )


def byte_histogram(spark, sf):
    return corpus.byte_histogram(table(spark, sf, "documents"))


def ws_tokens(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", tx.ws_tokens(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def delim_fields(spark, sf):
    return corpus.field_counts(table(spark, sf, "pages"), "url", "/").select(
        F.col("pos").cast("bigint").alias("pos"), "field", "n"
    )


def markup_fields(spark, sf):
    fields = table(spark, sf, "pages").select("page_id", tx.delimited_fields(F.col("html"), "<").alias("f"))
    return fields.select(
        "page_id", F.size("f").cast("bigint").alias("n_fields"), F.md5(F.array_join("f", "|")).alias("digest")
    )


def regex_matches(spark, sf):
    return corpus.match_counts(table(spark, sf, "documents"), NUMBER)


def symbol_words(spark, sf):
    words = vocab.word_freq(table(spark, sf, "conversations"))
    spelled = tx.joined(tx.byte_list(F.col("word")), " ")
    return words.select("word", spelled.alias("symbols"), "freq")


def prefix_histogram(spark, sf):
    words = vocab.word_freq(table(spark, sf, "documents"))
    return corpus.prefix_histogram(words, 3, freq=F.col("freq"))


def alphabet_coverage(spark, sf):
    out = corpus.alphabet_coverage(table(spark, sf, "documents"), "lang")
    return out.withColumn("unknown_share", r6("unknown_share"))


QUERIES = {
    "corpus_scan": corpus_scan,
    "path_rollup": path_rollup,
    "path_join": path_join,
    "vocab_table": vocab_table,
    "vocab_versions": vocab_versions,
    "byte_histogram": byte_histogram,
    "ws_tokens": ws_tokens,
    "delim_fields": delim_fields,
    "markup_fields": markup_fields,
    "regex_matches": regex_matches,
    "symbol_words": symbol_words,
    "prefix_histogram": prefix_histogram,
    "alphabet_coverage": alphabet_coverage,
}

ORACLES = {
    "corpus_scan": (
        "SELECT doc_id, strlen(t) AS n_bytes, md5(t) AS digest FROM "
        "(SELECT doc_id, split_part(text, chr(0), 1) AS t FROM documents) WHERE t <> ''"
    ),
    "path_rollup": (
        "SELECT dirname, count(*) AS n_paths, count(DISTINCT basename) AS n_basenames, max(depth) AS max_depth FROM ("
        "SELECT CASE WHEN coalesce(url, '') = '' THEN '' WHEN instr(url, '/') = 0 THEN '.' "
        "ELSE coalesce(nullif(regexp_extract(url, '^((?s).*)/[^/]*$', 1), ''), '/') END AS dirname, "
        "coalesce(split_part(url, '/', -1), '') AS basename, "
        "len(list_filter(string_split(url, '/'), lambda p: p <> '')) AS depth FROM pages) GROUP BY dirname"
    ),
    "path_join": (
        "SELECT page_id, CASE WHEN d <> '' AND b <> '' THEN d || CASE WHEN ends_with(d, '/') THEN '' ELSE '/' END || b END AS whole, "
        "CASE WHEN url <> '' THEN url || CASE WHEN ends_with(url, '/') THEN '' ELSE '/' END || 'index.html' END AS below FROM ("
        "SELECT page_id, url, CASE WHEN coalesce(url, '') = '' THEN '' WHEN instr(url, '/') = 0 THEN '.' "
        "ELSE coalesce(nullif(regexp_extract(url, '^((?s).*)/[^/]*$', 1), ''), '/') END AS d, "
        "coalesce(split_part(url, '/', -1), '') AS b FROM pages)"
    ),
    "vocab_table": words_sql("documents"),
    "vocab_versions": (
        f"WITH d AS ({words_sql('documents')}), c AS ({words_sql('conversations')}) SELECT word, "
        "(coalesce(d.freq, 0) + coalesce(c.freq, 0))::BIGINT AS freq, coalesce(d.freq, 0)::BIGINT AS old_freq "
        "FROM d FULL JOIN c USING (word)"
    ),
    "byte_histogram": (
        "SELECT ('0x' || h)::INT AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all("
        "hex(encode(split_part(text, chr(0), 1))), '..')) AS h FROM documents) GROUP BY h"
    ),
    "ws_tokens": (
        f"SELECT doc_id, len(l) AS n_tokens, array_to_string(l, ' ') AS tokens FROM "
        f"(SELECT doc_id, list_filter({SPLIT_SQL}, lambda w: w <> '') AS l FROM documents)"
    ),
    "delim_fields": (
        "SELECT pos, field, count(*) AS n FROM (SELECT generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS field FROM "
        "(SELECT CASE WHEN l[-1] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM "
        "(SELECT string_split(url, '/') AS l FROM pages))) GROUP BY pos, field"
    ),
    "markup_fields": (
        "SELECT page_id, len(l) AS n_fields, md5(array_to_string(l, '|')) AS digest FROM "
        "(SELECT page_id, CASE WHEN l[-1] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM "
        "(SELECT page_id, string_split(html, '<') AS l FROM pages))"
    ),
    "regex_matches": (
        "SELECT match, count(*) AS n FROM (SELECT unnest(regexp_extract_all(split_part(text, chr(0), 1), "
        f"'{NUMBER}')) AS match FROM documents) WHERE match <> '' GROUP BY match"
    ),
    "symbol_words": (
        "SELECT word, array_to_string(regexp_extract_all(hex(encode(word)), '..'), ' ') AS symbols, freq FROM "
        f"({words_sql('conversations')})"
    ),
    "prefix_histogram": (
        "SELECT CASE WHEN strlen(word) >= 3 THEN left(hex(encode(word)), 6) END AS prefix, sum(freq)::BIGINT AS n "
        f"FROM ({words_sql('documents')}) GROUP BY 1"
    ),
    "alphabet_coverage": (
        f"SELECT lang, n_bytes, n_unknown, {q6('n_unknown / n_bytes')} AS unknown_share FROM (SELECT lang, "
        "sum(strlen(t))::BIGINT AS n_bytes, "
        "sum(strlen(t) - strlen(regexp_replace(t, '[^ -~]', '', 'g')))::BIGINT AS n_unknown "
        "FROM (SELECT lang, split_part(text, chr(0), 1) AS t FROM documents) GROUP BY lang)"
    ),
}
