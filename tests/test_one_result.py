"""One result per operator, whatever the size: every branch, odd bytes, lengths, ties and types."""

import datetime as dt
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from brute import encode, train, words_of
from pyspark.sql import functions as F

from lexivec.functions import formats as fm
from lexivec.functions import text as tx
from lexivec.functions import vectors as vx
from lexivec.operators import bpe, codec, corpus, keyed, learn, linear, ordering, tokens, vocab
from lexivec.plans import tokenizer as plan
from lexivec.scratch import Scratch

RAW = [b"ab \xff\xfe ab", b"\xff \xfe", b"a\xff b\xfe", b"ab\x00cd12 12", b"caf\xc3\xa9 \x80\x80\x80\x80 12,5", b"", b"\xe2\x82 \xe2\x82\xac abab"]


@pytest.fixture(scope="module")
def raw(spark):
    """Bytes that are not UTF-8, in a string column, as a reader of plain files gives them."""
    rows = spark.createDataFrame(list(enumerate(map(bytearray, RAW))), "doc_id int, raw binary")
    return rows.select("doc_id", F.col("raw").cast("string").alias("text"))


def test_words_of_any_bytes(raw):
    want = Counter(w for b in RAW for w in words_of(b))
    got = vocab.word_freq(raw).select(F.col("word").cast("binary").alias("w"), "freq").collect()
    assert {bytes(r["w"]): r["freq"] for r in got} == want


def test_histogram_of_any_bytes(raw):
    want = Counter(b for t in RAW for b in t.split(b"\0", 1)[0])
    assert {r["byte"]: r["n"] for r in corpus.byte_histogram(raw).collect()} == want


def test_training_and_codec_of_any_bytes(raw):
    merges = plan.learn_merges(raw, 12).cache()
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == train(RAW, 12)
    model = tokens.tokenizer_build(merges).cache()
    rows = model.collect()
    ids = {bytes.fromhex(r["token"]): r["id"] for r in rows}
    ranks = {bytes.fromhex(r["token"]): r["rank"] for r in rows if r["rank"] is not None}
    coded = codec.encode_corpus(raw, model)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got == {i: encode(b, ids, ranks, b"<|unk|>") for i, b in enumerate(RAW)}
    back = {i: "".join(t.hex().upper() for t in (next(k for k, v in ids.items() if v == x) for x in got[i])) or None for i in got}
    assert {r["doc_id"]: r["decoded"] for r in codec.decode_corpus(coded, model, ["doc_id"]).collect()} == back


def test_nothing_is_read_after_a_nul(spark):
    docs = spark.createDataFrame([(1, "ab\0cd12<|bos|>")], "g int, text string")
    assert corpus.alphabet_coverage(docs, "g").first()["n_bytes"] == 2
    assert corpus.match_counts(docs, "[0-9]+").count() == 0
    merges = plan.learn_merges(docs, 1)
    assert {r["n_docs"] for r in tokens.special_usage(docs, merges).collect()} == {0}


def test_decoding_branches_agree(spark):
    table = spark.createDataFrame([(0, "61"), (1, "62"), (3, "6362")], "id int, token string").withColumn("rank", F.lit(None).cast("int"))
    rows = [(1, [0, 1]), (1, [1, 0, 3]), (2, []), (3, None), (4, [2]), (5, [0, None]), (6, [-1]), (7, [9]), (8, [3] * 10_000)]
    encoded = spark.createDataFrame(rows, "k int, ids array<int>")
    one = codec.decode_corpus(encoded, table, ["k"])
    two = codec.decode_corpus(encoded, table, ["k"], inline_tokens=1)
    assert one.schema == two.schema
    read = lambda d: sorted((r["k"], r["decoded"] or "") for r in d.collect())
    assert read(one) == read(two)
    assert read(one)[:3] == [(1, "6162"), (1, "62616362"), (2, "")] and len(read(one)) == len(rows)


def test_unknown_bytes_without_an_unknown_token(spark):
    table = spark.createDataFrame([(0, "61", None), (1, "62", None), (2, "6162", 0)], "id int, token string, rank int")
    docs = spark.createDataFrame([("ab?a",)], "text string")
    assert codec.encode_corpus(docs, table).first()["ids"] == [2, -1, 0]


def test_products_of_blocks_agree(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0), (5, 2, 4.0)], "row int, col int, val double")
    frame = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 2.0])], "k int, v array<double>")
    read = lambda d: sorted((r["k"], r["row"], str(r["val"])) for r in d.collect())
    whole = linear.matmul(frame, cells, "k", "v")
    parts = linear.matmul(frame, cells, "k", "v", block_cells=4)
    assert read(whole) == read(parts) and whole.schema == parts.schema
    assert len(read(whole)) == 2 * 6 and (1, 1, "0.0") in read(whole) and (3, 2, "nan") in read(whole)
    long = linear.matmul_by_join(frame, cells, "k", "v")
    assert {(k, r): v for k, r, v in read(long)} == {
        (k, r): v for k, r, v in read(whole) if r in (0, 2, 5) and k == 1} | {(3, 0): "5.0", (3, 2): "nan", (3, 5): "8.0"}
    for product in (linear.matmul, linear.matmul_by_join):
        with pytest.raises(Exception, match="elements"):
            product(frame.select("k", F.array(F.lit(1.0), F.lit(2.0)).alias("v")), cells, "k", "v").collect()


def test_scoring_of_any_key(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(90, 4)).tolist()
    data[7] = data[3]  # a tie
    rows = [(f"k{n:03d}", v) for n, v in enumerate(data)] + [("none", None)]
    frame = spark.createDataFrame(rows, "k string, v array<double>").repartition(4)
    queries = spark.createDataFrame([(dt.date(2020, 1, 1 + n), data[n]) for n in range(5)] + [(None, None)], "q date, v array<double>")
    read = lambda d: sorted((r["q"], r["rank"], r["k"], round(r["score"], 9)) for r in d.collect())
    one = read(linear.tied_scoring(frame, queries, "k", "v", "q", 6))
    assert one == read(linear.tied_scoring(frame, queries, "k", "v", "q", 6, block_cells=4)) and len(one) == 30
    assert [k for q, _, k, _ in one if q == dt.date(2020, 1, 4)][:2] == ["k003", "k007"]


def test_lengths_are_checked(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="without 2 elements"):
        learn.scatter_add(frame, "k", "v", 2).collect()
    with pytest.raises(Exception, match="without 2 elements"):
        learn.column_sums(frame, "v", 2, "s").collect()
    with pytest.raises(Exception, match="does not have 4 elements"):
        frame.select(vx.rotary(F.col("v"), F.lit(1), 2, 2)).collect()
    short = F.array(F.lit(1.0))
    for value in (vx.residual_add(F.col("v"), short), vx.rmsnorm(F.col("v"), short)):
        with pytest.raises(Exception, match="3 and 1 elements"):
            frame.select(value).collect()
    with pytest.raises(Exception, match="3 and 1 elements"):
        linear.swiglu(frame, frame.select("k", short.alias("v")), "k", "v", 1.0).collect()


def test_rotation_and_back(spark):
    frame = spark.createDataFrame([([1.0, -2.0, 3.0, 0.5], 7)], "v array<double>, p int")
    turned = frame.select(vx.rotary(F.col("v"), F.col("p"), 2, 2).alias("v"), "p")
    back = turned.select(vx.rotary(F.col("v"), F.col("p"), 2, 2, inverse=True)).first()[0]
    assert np.allclose(back, [1.0, -2.0, 3.0, 0.5])


def test_first_arrival_in_its_own_type(spark):
    none = spark.createDataFrame([], "k int, v int")
    at = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, 9, at), (1, 1, at + dt.timedelta(seconds=0.5))], "k int, v int, t timestamp")
    assert keyed.first_wins_upsert(none, batch, "k", "v", "t").first()["v"] == 9
    named = spark.createDataFrame([(1, 5, "b"), (1, 6, "a")], "k int, v int, t string")
    assert keyed.first_wins_upsert(none, named, "k", "v", "t").first()["v"] == 6


def test_blocked_format_with_non_finite_numbers(spark):
    rows = [[math.inf, 1.0] + [0.0] * 6, [math.nan, 3.0, 1.0] + [0.0] * 5, [math.nan] * 8, [-math.inf] + [0.0] * 7]
    codes, shared = fm.q8_matrix(np.array(rows))
    assert shared[:, 0].tolist() == [8, -6, 0, 8]
    assert codes[0, :2].tolist() == [127, 0] and codes[1, :3].tolist() == [0, 127, 64]
    assert codes[2].tolist() == [0] * 8 and codes[3, 0] == -127


def test_codes_have_the_bytes_of_their_format(spark):
    frame = spark.createDataFrame([([1.0, -1.5, 0.1],)], "v array<float>")
    for name, kind in (("e4m3", "tinyint"), ("e5m10", "smallint"), ("e8m7", "smallint"), ("e8m23", "int")):
        coded = frame.select(fm.encode_scalar(name)(F.col("v")).alias("c"))
        assert coded.schema["c"].dataType.simpleString() == f"array<{kind}>"
        back = coded.select(fm.decode_scalar(name)(F.col("c"))).first()[0]
        assert back[:2] == [1.0, -1.5]
    assert frame.select(F.transform(fm.encode_scalar("e4m3")(F.col("v")), lambda c: fm.unsigned(c, "e4m3"))).first()[0] == [0x38, 0xBC, 0x1C]


def test_hot_keys_use_several_tasks(spark):
    """Equal rows of one key are split over tasks when the join shuffles."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") < 199_000, 1).otherwise(F.col("id")).alias("k"))
        table = spark.createDataFrame([(k, k * 2) for k in (1, 199_500)], "k bigint, v bigint")
        found = keyed.lookup(rows, table, "k").select("k", "v", F.spark_partition_id().alias("p"))
        assert found.filter("k = 1").select("p").distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_set_comparisons(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([1, 2, 2], [2, 1, 3]))
    none = a.limit(0)
    assert keyed.set_subset(a, b).first()[0] and not keyed.set_subset(b, a).first()[0] and keyed.set_subset(none, a).first()[0]
    assert not keyed.set_equal(a, b).first()[0] and keyed.set_equal(a, a).first()[0] and keyed.set_equal(none, none).first()[0]
    nulls = spark.createDataFrame([(None,), (1,)], "v int")
    assert not keyed.set_subset(nulls, a).first()[0] and keyed.set_equal(nulls, nulls).first()[0]


def test_softmax_over_a_null_group_and_a_wide_range(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), ("a", 3, -3000.0), ("a", 4, 900.0), ("a", 5, 901.0), ("b", 6, None), ("b", 7, -5.0)]
    frame = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r["k"]: r["p"] for r in linear.softmax_by_group(frame, "g", "k", "v").collect()}
    e = math.e
    assert got[1] == pytest.approx(1 / (1 + e)) and got[5] == pytest.approx(e / (1 + e)) and got[3] == 0.0
    assert got[6] is None and got[7] == pytest.approx(1.0)


def test_byte_order_of_strings(spark):
    words = ["é", "z", "Z", "", "\U0001f600", "\uffff", "e\u0301"]
    frame = spark.createDataFrame(list(enumerate(words)), "t int, w string")
    got = [r["w"] for r in ordering.sorted_rank_bytes(frame, "w", "t").orderBy("rank").collect()]
    assert got == sorted(words, key=str.encode)


def test_ranks_leave_nothing_behind(spark):
    frame = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    with Scratch(spark, "rank") as scratch:
        ranks = ordering.sorted_rank(frame, "k", "id", scratch=scratch)
        order = linear.sequence_positions(frame, "k", "id", scratch=scratch)
        assert [r["rank"] for r in ranks.orderBy("k", "id").collect()] == list(range(1, 101))
        assert order.agg(F.max("pos")).first()[0] == 14
        folder = Path(scratch.root.removeprefix("file://"))
        assert len(list(folder.iterdir())) == 2
    assert not folder.exists()


@pytest.mark.parametrize("leaders", [3, 4096])
def test_many_merges_a_pass_equal_one_at_a_time(spark, leaders):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefgh", weights=[5, 4, 4, 3, 2, 2, 1, 1], k=rng.randrange(2, 9))) for _ in range(900))
    symbols = vocab.symbol_freq(vocab.word_freq(spark.createDataFrame([(text,)], "text string"))).cache()
    want, trace = train([text], 40), []
    assert [tuple(r) for r in bpe.bpe_train(symbols, 40, leaders=leaders, trace=trace).collect()] == want
    assert sum(trace) == 40 and len(trace) < 40


def test_published_ids_of_a_prompt(spark):
    """The documented ids belong to another corpus; the rule that gives them holds for any: specials, bytes, merges."""
    docs = spark.createDataFrame([("hello world new old the low newer lower test est",)], "text string")
    merges = plan.learn_merges(docs, 6)
    model = tokens.tokenizer_build(merges)
    rows = {r["id"]: r for r in model.collect()}
    assert [bytes.fromhex(rows[i]["token"]).decode() for i in range(4)] == ["<|bos|>", "<|eos|>", "<|pad|>", "<|unk|>"]
    core = [bytes.fromhex(rows[i]["token"]) for i in range(4, len(rows))]
    assert core == sorted(core) and core[0] == b" " and len(core) == 95 + len({r["a"] + r["b"] for r in merges.collect()})
    ids = codec.encode_corpus(spark.createDataFrame([("Hello, world!",)], "text string"), model).first()["ids"]
    assert b"".join(bytes.fromhex(rows[i]["token"]) for i in ids) == b"Hello, world!"


def test_word_fields_keep_their_plain_form(spark):
    row = spark.createDataFrame([("a  b\tc ",)], "t string").select(tx.ws_tokens(F.col("t"))).first()[0]
    assert row == ["a", "b", "c"]
