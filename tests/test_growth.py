"""Training that goes on, dictionaries of chunks, versions of tables and the keyed store."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexivec.functions import symbols as sy
from lexivec.operators import bpe, codec, dictionary, keyed, vocab
from lexivec.operators import random as random_ops
from lexivec.plans.tokenizer import learn_tokenizer
from lexivec.scratch import Scratch
from lexivec.sources import tables
from lexivec.sources.keyed_store import KeyedStore


def corpus(seed, n=120):
    rng = random.Random(seed)
    stems = ["low", "lower", "new", "newest", "wide", "aaaa", "abab", "ba", "é", "日本", "x" * 40, "lowlowlow"]
    return ["".join(rng.choice(["", " ", "\n"]) + rng.choice(stems) for _ in range(30)) for _ in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)


def plain_training(words, merges, learned=()):
    """Merges one at a time over a Counter of byte words; the learned ones are applied first, whatever their counts."""
    held = [([bytes([b]) for b in w], n) for w, n in words.items()]
    out = []
    for k in range(merges):
        pairs = Counter()
        for parts, n in held:
            for pair in zip(parts, parts[1:]):
                pairs[pair] += n
        if k < len(learned):
            best = learned[k][:2]
            out.append(learned[k])
        else:
            if not pairs:
                break
            best = min(pairs, key=lambda p: (-pairs[p], f"{p[0].hex().upper()}20{p[1].hex().upper()}"))
            out.append((*best, pairs[best]))
        for parts, _ in held:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == best:
                    parts[i : i + 2] = [best[0] + best[1]]
                i += 1
    return out


def counted(texts):
    return Counter(w.encode() for t in texts for w in t.split())


def as_plain(merges):
    return [(bytes.fromhex(r["a"]), bytes.fromhex(r["b"]), r["freq"]) for r in sorted(merges.collect())]


def test_training_goes_on(spark):
    """In two parts as in one; after the corpus has grown as a plain version that applies the saved merges first."""
    old, more = corpus(1), corpus(2, 60) + ["zzzz zzzz zz newer"] * 50
    docs = docs_of(spark, old)
    words = vocab.word_freq(docs)
    symbols = vocab.symbol_freq(words)
    whole = as_plain(bpe.bpe_train(symbols, 12))
    assert whole == plain_training(counted(old), 12)
    first = bpe.bpe_train(symbols, 5)
    assert as_plain(bpe.bpe_train(symbols, 12, learned=first)) == whole
    assert as_plain(bpe.bpe_train(symbols, 5, learned=first)) == as_plain(first) == as_plain(bpe.bpe_train(symbols, 2, learned=first)) + whole[2:5]
    grown = vocab.counting_upsert(words, vocab.word_freq(docs_of(spark, more)))
    got = as_plain(bpe.bpe_train(vocab.symbol_freq(grown), 12, learned=first, leaders=4))
    assert got == plain_training(counted(old + more), 12, whole[:5]) and got[5:] != whole[5:]
    with pytest.raises(ValueError, match="ranks"):
        bpe.bpe_train(symbols, 12, learned=first.filter("rank > 2"))


def test_pair_table_is_a_count(spark, monkeypatch):
    """After every read the table holds what a count of the words at that moment gives."""
    seen = []
    counts = bpe.PairTable.counts

    def check(self):
        out = counts(self)
        seen.append({r["pair"]: r["n"] for r in out.collect()})
        return out

    monkeypatch.setattr(bpe.PairTable, "counts", check)
    monkeypatch.setattr(bpe, "CHANGES", 10)
    texts = corpus(3)
    merges = bpe.bpe_train(vocab.symbol_freq(vocab.word_freq(docs_of(spark, texts))), 10, leaders=3, ahead=4)
    rows = [(r["rank"], r["a"], r["b"]) for r in sorted(merges.collect())]
    states = []
    for k in range(len(rows) + 1):
        ranks = bpe._symbols_of(rows[:k])[2]
        now = Counter()
        for word, n in counted(texts).items():
            syms = bpe.replayed(word.decode("latin-1"), ranks)
            for i in range(len(syms) - 1):
                now[syms[i : i + 2]] += n
        states.append(dict(now))
    assert len(seen) > 2 and all(s in states for s in seen)


def test_replay_is_one_merge_after_the_other():
    rng = random.Random(5)
    for _ in range(200):
        contents, rows = [f"{b:02X}" for b in b"abc"], []
        for rank in range(12):
            a, b = rng.choice(contents), rng.choice(contents)
            rows.append((rank, a, b))
            contents.append(a + b)
        table, known, ranks = bpe._symbols_of(rows)
        word = "".join(rng.choice("abc") for _ in range(25))
        slow = word
        for _, a, b in rows:
            pair = "".join(sy.symbol_char(known[x] if x in known else int(x, 16)) for x in (a, b))
            slow = slow.replace(pair, sy.symbol_char(known[a + b]))
        assert bpe.replayed(word, ranks) == slow
        assert "".join(table[sy.symbol_index(c)] for c in slow) == word.encode().hex().upper()


def test_training_with_saves(spark):
    path = Scratch(spark, "test").path("saves")
    symbols = vocab.symbol_freq(vocab.word_freq(docs_of(spark, corpus(1))))

    def load():
        return tables.load_table(spark, path, "merges") if tables.table_versions(spark, path) else None

    def dies(merges):
        tables.save_table(merges, path, "merges")
        if merges.count() >= 6:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        bpe.train_with_saves(symbols, 8, load, dies, every=3)
    assert tables.table_versions(spark, path) == [1, 2]
    done = bpe.train_with_saves(symbols, 8, load, lambda m: tables.save_table(m, path, "merges"), every=3)
    assert as_plain(done) == plain_training(counted(corpus(1)), 8) and tables.table_versions(spark, path) == [1, 2, 3]
    assert as_plain(bpe.train_with_saves(symbols, 4, load, dies)) == as_plain(done)[:4]
    short = vocab.symbol_freq(vocab.word_freq(docs_of(spark, ["ab ab"])))
    assert len(as_plain(bpe.train_with_saves(short, 9, lambda: None, lambda m: None, every=2))) == 1


@pytest.mark.parametrize("hot", [3, 1 << 16])
def test_dictionary_gives_the_narrow_encoding(spark, docs, hot, monkeypatch):
    more = docs.unionByName(docs_of(spark, corpus(4, 30)).withColumn("doc_id", F.col("doc_id") + 100))
    more = more.unionByName(spark.createDataFrame([(900, None), (901, ""), (5, "low low"), (5, "low low")], "doc_id int, text string"))
    more = more.select("doc_id", F.lit("kept").alias("chunk"), "text", F.lit(3).alias("n"))
    tokenizer = learn_tokenizer(docs_of(spark, corpus(4, 30)), 25)
    want = codec.encode_corpus(more, tokenizer)
    monkeypatch.setattr(codec, "encode_corpus", None)  # the narrow form is not taken
    got = dictionary.encode_by_dictionary(more, tokenizer, hot=hot)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dictionary_stores_no_half_made_ids(spark, docs, monkeypatch):
    """Texts are shuffled to the entries of their rare chunks and encoded then; nothing but the dictionary is stored."""
    tokenizer = learn_tokenizer(docs, 25)
    copies = docs.unionByName(docs)  # equal texts share their entries
    want, stored, write = codec.encode_corpus(copies, tokenizer), [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: stored.append(name) or write(self, df, name))
    got = dictionary.encode_by_dictionary(copies, tokenizer, hot=2)
    assert stored == ["chunks"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dictionary_without_chunks(spark):
    """A token over a blank is no chunk's: the narrow form is taken."""
    rows = [(0, "61", None), (1, "20", None), (2, "612061", 1), (3, "6120", 0)]
    tokenizer = spark.createDataFrame(rows, "id int, token string, rank int")
    docs = spark.createDataFrame([(1, "a a a")], "doc_id int, text string")
    assert dictionary.encode_by_dictionary(docs, tokenizer).collect() == codec.encode_corpus(docs, tokenizer).collect()


def test_versions(spark):
    path = Scratch(spark, "test").path("versions")
    one, two = (spark.createDataFrame(rows, "word string, freq bigint") for rows in ([("a", 1)], [("a", 2), ("b", 1)]))
    assert tables.table_versions(spark, path) == []
    with pytest.raises(ValueError, match="no table"):
        tables.load_table(spark, path, "vocab")
    assert tables.save_table(one, path, "vocab") == 1
    pinned = tables.load_table(spark, path, "vocab")
    assert tables.save_table(two, path, "vocab") == 2
    assert sorted(tables.load_table(spark, path, "vocab").collect()) == sorted(two.collect())
    assert pinned.collect() == one.collect() == tables.load_table(spark, path, "vocab", version=1).collect()
    with pytest.raises(ValueError, match="version 7"):
        tables.load_table(spark, path, "vocab", version=7)
    # A table that reads the version before it can replace it; a save that died before its manifest is not seen.
    tables.save_table(vocab.counting_upsert(tables.load_table(spark, path, "vocab"), one), path, "vocab")
    one.write.parquet(f"{path}/rows/unfinished")
    tables._Folder(spark, path).write("manifests/unfinished.new", "{")
    assert {r["word"]: r["freq"] for r in tables.load_table(spark, path, "vocab").collect()} == {"a": 3, "b": 1}
    assert tables.drop_versions(spark, path) == [1, 2] and tables.table_versions(spark, path) == [3]
    assert tables.load_table(spark, path, "vocab").count() == 2


def test_two_writers_get_two_versions(spark, monkeypatch):
    """A writer that finds its number taken at the rename goes on to the next."""
    path = Scratch(spark, "test").path("race")
    frame = spark.createDataFrame([("a", 1)], "word string, freq bigint")
    tables.save_table(frame, path, "vocab")
    monkeypatch.setattr(tables, "_versions", lambda folder: [])  # sees no version, as before the other's rename
    assert tables.save_table(frame, path, "vocab") == 2


def test_a_changed_row_count_is_refused(spark):
    path = Scratch(spark, "test").path("counted")
    frame = spark.createDataFrame([("a", 1), ("b", 1)], "word string, freq bigint")
    tables.save_table(frame, path, "vocab")
    manifest = json.loads(tables._Folder(spark, path).read("manifests/1.json"))
    frame.limit(1).write.mode("overwrite").parquet(f"{path}/rows/{manifest['rows']}")
    with pytest.raises(ValueError, match="manifest says 2"):
        tables.load_table(spark, path, "vocab")


def read(frame):
    return sorted(map(str, map(tuple, frame.collect())))


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_keyed_store(spark):
    rng = random.Random(6)

    def batch(n):
        rows = [(rng.choice([None, *range(40)]), rng.random(), rng.randrange(30)) for _ in range(n)]
        return spark.createDataFrame(rows, "key int, value double, at int").repartition(3)

    first, second, third = batch(50), batch(200), batch(80)
    store = KeyedStore(spark, "things", "key", "value", 4).create(first, "at")
    plain = keyed.first_wins_upsert(first.limit(0), first, "key", "value", "at")
    for more in (second, third):
        store.upsert(more, "at")
        plain = keyed.first_wins_upsert(plain, more, "key", "value", "at")
        assert read(store.table().select("key", "value")) == read(plain.select("key", "value"))
    rows = spark.createDataFrame([(k, "x") for k in [*range(30, 50), 3, 3, None]], "key int, other string")
    assert read(store.lookup(rows).select("key", "other", "value")) == read(keyed.lookup(rows, plain, "key").select("key", "other", "value"))
    assert read(store.contains(rows)) == read(keyed.set_contains(rows, plain, "key"))
    gone = spark.createDataFrame([(k,) for k in [1, 1, 2, 99, None]], "key int")
    assert read(store.delete(gone).table()) == read(keyed.delete_keys(plain, gone, "key"))
    store.drop()
    with pytest.raises(ValueError, match="create it first"):
        store.table()


def test_the_stored_side_is_not_moved(spark):
    """Only the batch is shuffled: one exchange for it, none above the scan of the table."""
    frame = spark.createDataFrame([(k, float(k), k) for k in range(200)], "key int, value double, at int")
    store = KeyedStore(spark, "still", "key", "value", 4).create(frame, "at")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        looked, plain = store.lookup(frame.select("key", "at")), keyed.lookup(frame.select("key", "at"), store.table().hint("merge"), "key")
        assert exchanges(looked) == 1 and "SortMergeJoin" in looked._jdf.queryExecution().executedPlan().toString()
        assert exchanges(plain) == 1  # the join moves the rows to the table's buckets here as well
        assert exchanges(store.table().groupBy("key").agg(F.max("value"))) == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    store.drop()


def serial_exchange(n, seed):
    """One pass over an array, as a loop."""
    out, state = list(range(n)), seed if seed > 0 else 123456789
    for i in range(n - 1, 0, -1):
        state = state * 48271 % 2147483647
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


@pytest.mark.parametrize("n, seed", [(0, 5), (1, 5), (2, 1337), (3, 2), (10, 123456789), (700, 1337), (3000, -1)])
def test_exchange_order_is_the_serial_one(spark, n, seed):
    rows = random_ops.exchange_order(spark, n, seed, Scratch(spark, "test")).collect()
    assert [r["origin"] for r in sorted(rows)] == serial_exchange(n, seed)


def test_exchange_of_rows(spark):
    rng = random.Random(3)
    keys = rng.sample(range(10_000), 150)
    table = spark.createDataFrame([(k, f"v{k}", 1) for k in keys], "k int, v string, position0 int").repartition(5)
    got = random_ops.exchange_rows(table, ["k"], 99).collect()
    want = [sorted(keys)[o] for o in serial_exchange(150, 99)]
    assert [r["k"] for r in sorted(got, key=lambda r: r["position"])] == want and all(r["v"] == f"v{r['k']}" for r in got)
    assert random_ops.exchange_rows(table.limit(0), ["k"], 99).collect() == []
