import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from brute import encode, train
from pyspark.sql import functions as F

from lexivec.functions import greedy
from lexivec.functions import symbols as sy
from lexivec.operators import bpe, codec, tokens, vocab
from lexivec.plans import tokenizer as plan
from lexivec.scratch import Scratch
from lexivec.sources import tables

UNKNOWN = b"<|unk|>"


@pytest.fixture(scope="module")
def merges(docs):
    return plan.learn_merges(docs, 40).cache()


@pytest.fixture(scope="module")
def model(merges):
    return tokens.tokenizer_build(merges).cache()


def texts_of(docs):
    return [r["text"] for r in docs.collect()]


def test_training_equals_brute_force(docs, merges):
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == train(texts_of(docs), 40)


def test_training_with_few_leaders_and_frequent_cuts(docs):
    symbols = vocab.symbol_freq(vocab.word_freq(docs))
    found = bpe.bpe_train(symbols, 25, cut_every=3, leaders=3).collect()
    assert [tuple(r) for r in found] == train(texts_of(docs), 25)


def test_same_token_from_two_merges(spark):
    """Both ways to build a token give one symbol, and the first merge keeps the rank."""
    words = ["abc"] * 3 + ["ab"] * 6 + ["xbc"] * 8 + ["bc"] * 9 + ["abcabc"] * 2
    docs = spark.createDataFrame([(" ".join(words),)], "text string")
    expected = train([" ".join(words)], 20)
    symbols = vocab.symbol_freq(vocab.word_freq(docs))
    assert [tuple(r) for r in bpe.bpe_train(symbols, 20, leaders=2).collect()] == expected


def test_training_stops_without_pairs_and_defaults(spark):
    single = spark.createDataFrame([("a b c a",)], "text string")
    assert plan.learn_merges(single, 5).count() == 0
    many = spark.createDataFrame([("abcdefghijklmnop",)], "text string")
    assert plan.learn_merges(many, 0).count() == bpe.DEFAULT_MERGES


def test_training_does_not_depend_on_partitions(docs, merges):
    expected = [tuple(r) for r in merges.orderBy("rank").limit(8).collect()]
    for parts in (1, 17):
        found = plan.learn_merges(docs.repartition(parts), 8).collect()
        assert [tuple(r) for r in found] == expected


def test_pairs_of_long_words_are_all_counted(spark):
    word = "".join(chr(97 + i % 7) for i in range(5 * sy.SEGMENT + 3))
    symbols = spark.createDataFrame([(word, 2)], "syms string, freq bigint")
    found = {r["pair"]: r["n"] for r in bpe.pair_counts(symbols).collect()}
    expected = {}
    for pair in zip(word, word[1:]):
        expected["".join(pair)] = expected.get("".join(pair), 0) + 2
    assert found == expected


def test_apply_merge_is_greedy_from_the_left(spark):
    symbols = spark.createDataFrame([("aaaaa", 1), ("aa", 2)], "syms string, freq bigint")
    found = {r["syms"]: r["freq"] for r in bpe.apply_merge(symbols, "aa", "Z").collect()}
    assert found == {"ZZa": 1, "Z": 2}


def test_symbol_characters_round_trip():
    for index in (0, 255, 256, 0xD7FF, 0xD800, 70000):
        char = sy.symbol_char(index)
        assert sy.symbol_index(char) == index and char.encode()


def test_token_table(merges, model):
    rows = {r["id"]: r for r in model.collect()}
    assert [bytes.fromhex(rows[i]["token"]).decode() for i in range(4)] == list(tokens.SPECIALS)
    core = [rows[i]["token"] for i in range(4, len(rows))]
    assert core == sorted(core) and len(set(core)) == len(core)
    first = merges.filter("rank = 0").first()
    top = next(r for r in rows.values() if r["token"] == first["a"] + first["b"])
    assert top["rank"] == 0 and top["score"] == 0.0
    assert rows[0]["score"] == -math.inf and rows[4]["score"] == -math.inf


def test_special_equal_to_a_token_is_refused(merges):
    with pytest.raises(ValueError):
        tokens.tokenizer_build(merges, ("<|bos|>", "<|eos|>", "<|pad|>", "A"))


def test_encode_equals_whole_text_scan(docs, model):
    rows = [(r["id"], bytes.fromhex(r["token"]), r["rank"]) for r in model.collect()]
    ids = {t: i for i, t, _ in rows}
    ranks = {t: r for _, t, r in rows if r is not None}
    texts = dict(docs.collect())
    for row in codec.encode_corpus(docs, model).collect():
        assert row["ids"] == encode(texts[row["doc_id"]], ids, ranks, UNKNOWN), row["doc_id"]


def test_decode_round_trip_and_bad_ids(spark, docs, model):
    encoded = codec.encode_corpus(docs.filter("doc_id in (1, 9, 10)"), model)
    texts = dict(docs.collect())
    for limit in (1, 100_000):
        for row in codec.decode_corpus(encoded, model, ["doc_id"], limit).collect():
            assert bytes.fromhex(row["decoded"]).decode() == texts[row["doc_id"]]
    size = model.count()
    bad = spark.createDataFrame([(1, [-1, 4]), (2, [size]), (3, []), (4, [size - 1, 0])], "doc_id int, ids array<int>")
    for limit in (1, 100_000):
        found = {r["doc_id"]: r["decoded"] for r in codec.decode_corpus(bad, model, ["doc_id"], limit).collect()}
        assert found[1] is None and found[2] is None and found[3] is None and found[4] is not None


def test_bos_eos_and_pairs(spark, model):
    docs = spark.createDataFrame([(1, "aba"), (2, "")], "doc_id int, text string")
    encoded = codec.encode_corpus(docs, model)
    plain = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    both = {r["doc_id"]: r["ids"] for r in codec.with_bos_eos(encoded).collect()}
    assert both[1] == [0, *plain[1], 1] and both[2] == [0, 1]
    pairs = {(r["id"], r["next_id"]): r["n"] for r in codec.next_token_pairs(encoded).collect()}
    assert sum(pairs.values()) == len(plain[1]) - 1


def test_tables_round_trip_and_manifest(spark, merges, model):
    scratch = Scratch(spark, "test")
    tables.save_table(merges, scratch.path("m"), "merges")
    assert sorted(tables.load_table(spark, scratch.path("m"), "merges").collect()) == sorted(merges.collect())
    with pytest.raises(ValueError):
        tables.load_table(spark, scratch.path("m"), "vocab")
    tables.save_table(model, scratch.path("t"), "tokenizer")
    assert tables.load_table(spark, scratch.path("t"), "tokenizer").count() == model.count()


def test_embedding_lookup_keeps_positions(spark, model):
    docs = spark.createDataFrame([(1, "abab")], "doc_id int, text string")
    encoded = codec.encode_corpus(docs, model)
    vectors = model.selectExpr("id", "array(cast(id as double)) as vec")
    rows = codec.embedding_lookup(encoded, vectors, ["doc_id"]).orderBy("pos").collect()
    assert [r["id"] for r in rows] == encoded.first()["ids"] and all(r["vec"] == [float(r["id"])] for r in rows)


def test_texts_are_encoded_in_slices(spark, docs, model, monkeypatch):
    """Ids of a few texts at a time, whatever the batch; every text whole, once and in order."""
    texts = pa.array([b"ab", None, b"", b"c" * 50, b"de", b"f" * 9, None])
    parts = [p.to_pylist() for p in codec._slices(texts[1:], 10)]
    assert parts == [[None, b""], [b"c" * 50], [b"de"], [b"f" * 9], [None]] and list(codec._slices(texts[:0])) == []
    assert [len(p) for p in codec._slices(texts)] == [7]
    whole = codec.encode_corpus(docs, model).orderBy("doc_id").collect()
    monkeypatch.setattr(codec, "SLICE_BYTES", 8)
    assert codec.encode_corpus(docs, model).orderBy("doc_id").collect() == whole


def table_of(merges, unknown=True):
    """A token table over the printable bytes; the rank of a token is its place in ``merges``."""
    specials = [t.encode() for t in tokens.SPECIALS] if unknown else []
    core = sorted({bytes([b]) for b in range(32, 127)} | set(merges))
    return [*((i, t, None) for i, t in enumerate(specials)),
            *((i + len(specials), t, merges.index(t) if t in merges else None) for i, t in enumerate(core))]


def test_arrays_of_texts_are_encoded_as_single_ones(monkeypatch):
    """Random tables, also with ranks out of order and tokens over whitespace, against a scan of each whole text."""
    rng = random.Random(5)
    for trial in range(120):
        letters = rng.choice(["ab", "abc ", "abé\n", "a<|unk>b"])
        pool, merges = [c.encode() for c in letters if " " <= c < "\x7f"], []
        for _ in range(rng.randrange(25)):
            token = rng.choice(pool) + rng.choice(pool)
            if token not in merges:
                merges.append(token)
                pool.append(token)
        if trial % 3 == 0:
            rng.shuffle(merges)
        monkeypatch.setattr(greedy, "STRETCH", rng.choice([1, 5, 64, 1 << 18]))
        monkeypatch.setattr(greedy, "SCAN_SYMBOLS", rng.choice([2, 128]))
        table = table_of(merges)
        ids, ranks = {t: i for i, t, _ in table}, {t: r for _, t, r in table if r is not None}
        texts = [None if k == 3 else "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 9, 60]))) for k in range(8)]
        found = greedy.TextEncoder(table, UNKNOWN).lists(pa.array(["x", *texts, "a\0b"], pa.binary())[1:]).to_pylist()
        assert found == [None if t is None else encode(t, ids, ranks, UNKNOWN) for t in [*texts, "a"]], (merges, texts)
    assert greedy.TextEncoder(table_of([b"ab"], False), None).lists(pa.array([b"\xe9ab"])).to_pylist() == [[-1, 66]]


def test_encoding_keeps_no_words(docs, model):
    """What a task holds does not follow the different words that it has met."""
    rows = [(r["id"], bytes.fromhex(r["token"]), r["rank"]) for r in model.collect()]
    coder, rng = greedy.TextEncoder(rows, UNKNOWN), random.Random(1)
    texts = [b" ".join(rng.randbytes(6).hex().encode() for _ in range(20_000)) for _ in range(4)]
    tracemalloc.start()
    try:
        for text in texts:
            coder.lists(pa.array([text]))
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 1 << 18 and most < 64 * len(texts[0]) < 20 << 20


@pytest.mark.parametrize("query", ["decode_corpus", "token_listing", "embedding_lookup"])
def test_a_task_of_new_words_holds_a_slice(spark, model, monkeypatch, query):
    """Batches of words that were not met before: what a task keeps does not follow them, and the query finds them whole."""
    taken, rng = [], random.Random(2)
    with monkeypatch.context() as patch:
        patch.setattr(codec.F, "arrow_udf", lambda run, kind: taken.append(run))
        codec.encoder(model)
    texts = [b" ".join(rng.randbytes(6).hex().encode() for _ in range(5_000)) for _ in range(12)]
    assert list(taken[0](iter([pa.array([b"low"])])))  # the token table is read
    ids = None
    tracemalloc.start()
    try:
        for ids in taken[0](pa.array([t]) for t in texts):
            pass
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 2 << 20
    encoded = spark.createDataFrame([("a", ids[0].as_py())], "lang string, ids array<int>")
    if query == "decode_corpus":
        assert bytes.fromhex(codec.decode_corpus(encoded, model, ["lang"]).first()["decoded"]) == texts[-1]
    if query == "token_listing":
        listed = {r["token"]: r["n"] for r in codec.token_listing(encoded, model, "lang").collect()}
        assert sum(len(bytes.fromhex(t)) * n for t, n in listed.items()) == len(texts[-1]) and sum(listed.values()) == len(ids[0])
    if query == "embedding_lookup":
        vectors = model.selectExpr("id", "array(cast(id as double)) as vec")
        rows = codec.embedding_lookup(encoded, vectors, ["lang"]).orderBy("pos").collect()
        assert [r["vec"] for r in rows] == [[float(i)] for i in ids[0].as_py()]


def test_tokens_stay_where_they_are(spark, docs, model, monkeypatch):
    """No token is shuffled to look up a table of checked size, and a larger one gives the same rows."""
    encoded = docs.select("doc_id", F.array(F.lit(3), F.lit(-7), F.lit(5), F.lit(5)).alias("ids"))
    vectors = model.selectExpr("id", "array(cast(id as double)) as vec")
    planned = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for name, run in (
            ("INLINE_TOKENS", lambda: codec.token_sequences(encoded, model, ["doc_id"])),
            ("BROADCAST_CELLS", lambda: codec.embedding_lookup(encoded, vectors, ["doc_id"])),
        ):
            near = run()
            monkeypatch.setattr(codec, name, 5)
            far = run()
            assert "(strategy=broadcast)" in planned(near) and "(strategy=broadcast)" not in planned(far)
            assert sorted(map(str, near.collect())) == sorted(map(str, far.collect())) and near.count() == 4 * docs.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
