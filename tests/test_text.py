from collections import Counter

import pytest
from brute import words_of
from pyspark.sql import functions as F

from lexivec.functions import text as tx
from lexivec.operators import corpus, vocab
from lexivec.sources import files


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression).first()[0]


@pytest.mark.parametrize(
    "text, delimiter, fields",
    [("a,,", ",", ["a", ""]), (",a", ",", ["", "a"]), ("", ",", []), ("a.b", ".", ["a", "b"]), ("ab", "", ["61", "62"])],
)
def test_delimited_fields(spark, text, delimiter, fields):
    assert one(spark, text, tx.delimited_fields(F.col("t"), delimiter)) == fields


def test_word_freq_matches_byte_rules(spark, docs):
    expected = Counter(w for r in docs.collect() for w in words_of(r["text"]))
    found = {r["word"].encode(): r["freq"] for r in vocab.word_freq(docs).collect()}
    assert found == expected


def test_byte_histogram_counts_every_byte_before_nul(spark, docs):
    expected = Counter(b for r in docs.collect() for b in r["text"].encode().split(b"\0", 1)[0])
    assert {r["byte"]: r["n"] for r in corpus.byte_histogram(docs).collect()} == expected


def test_corpus_scan_drops_empty_and_cuts_at_nul(spark, docs):
    kept = {r["doc_id"]: r["text"] for r in corpus.corpus_scan(docs).collect()}
    assert 2 not in kept and kept[7] == "seen"


def test_regex_matches_use_unicode_classes(spark):
    assert one(spark, "naïve 12 ab", tx.regex_matches(F.col("t"), r"\w+")) == ["naïve", "12", "ab"]


def test_join_of_nothing_is_null(spark):
    assert one(spark, " ", tx.joined(tx.ws_tokens(F.col("t")), "-")) is None


@pytest.mark.parametrize(
    "path, dirname, basename",
    [("a/b/c", "a/b", "c"), ("c", ".", "c"), ("/c", "/", "c"), ("a/", "a", ""), ("", "", "")],
)
def test_paths(spark, path, dirname, basename):
    assert one(spark, path, tx.path_dirname(F.col("t"))) == dirname
    assert one(spark, path, tx.path_basename(F.col("t"))) == basename


def test_path_join_and_parts(spark):
    assert one(spark, "a/", tx.path_join(F.col("t"), F.lit("b"))) == "a/b"
    assert one(spark, "a", tx.path_join(F.col("t"), F.lit("b"))) == "a/b"
    assert one(spark, "//a//b/", tx.path_parts(F.col("t"))) == ["a", "b"]


def test_prefix_is_null_for_short_words(spark):
    assert one(spark, "ab", tx.byte_prefix(F.col("t"), 3)) is None
    assert one(spark, "éa", tx.byte_prefix(F.col("t"), 2)) == "C3A9"


def test_alphabet_coverage(spark, docs):
    row = corpus.alphabet_coverage(docs.filter("doc_id = 5").withColumn("g", F.lit(1)), "g").first()
    data = docs.filter("doc_id = 5").first()["text"].encode()
    assert row["n_bytes"] == len(data) and row["n_unknown"] == sum(b > 0x7E for b in data)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("x")
    assert [r["text"] for r in files.read_corpus(spark, str(tmp_path / "*.txt")).collect()] == ["hello world"]
    assert {r["basename"] for r in files.list_files(spark, str(tmp_path)).collect()} == {"a.txt", "empty.txt"}
    assert {r["size"] for r in files.list_files(spark, str(tmp_path)).collect()} == {0, 11}
    assert [r["name"] for r in files.list_dirs(spark, str(tmp_path)).collect()] == ["sub"]
