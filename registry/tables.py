"""Keyed tables, sets, sorts, bucket reports and random columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import hashing as hs
from lexivec.functions import random as rn
from lexivec.operators import bloom, keyed, ordering, vocab
from lexivec.operators import random as rd
from lexivec.sources.keyed_store import KeyedStore
from registry.common import lehmer_sql, q6, r6, table, words_sql

SEED = 1337
BUCKETS = 64
STORE_BUCKETS = 8
WIDTH = 64


def words_of(spark, sf, name):
    return vocab.word_freq(table(spark, sf, name)).select("word")


def first_wins_upsert(spark, sf):
    """The customers of one segment are the held table, and the orders of all customers the batch."""
    held = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    held = held.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    batch = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival")
    )
    return keyed.first_wins_upsert(held, batch, "key", "value", "arrival")


def keyed_store(spark, sf):
    """Customers of one segment, then the orders of all, without the customers in debt; looked up for every customer."""
    customers = table(spark, sf, "customer")
    held = customers.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit(0).alias("arrival")
    )
    batch = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival")
    )
    store = KeyedStore(spark, "customers", "key", "value", STORE_BUCKETS).create(held, "arrival").upsert(batch, "arrival")
    store.delete(customers.filter("c_acctbal < 0").select(F.col("c_custkey").alias("key")))
    return store.lookup(customers.select(F.col("c_custkey").alias("key"), "c_nationkey"))


def counting_upsert(spark, sf):
    return vocab.counting_upsert(
        vocab.word_freq(table(spark, sf, "documents")), vocab.word_freq(table(spark, sf, "conversations"))
    )


def lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    found = keyed.lookup(docs, table(spark, sf, "labels"), "doc_id")
    return found.select("doc_id", "lang", *[F.col(c).cast("double").alias(c) for c in ("quality", "toxic")])


def lookup_nation(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return keyed.lookup(rows, names, "c_nationkey")


def delete_keys(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return keyed.delete_keys(docs, table(spark, sf, "labels").filter("toxic = 1"), "doc_id")


def delete_not_found(spark, sf):
    """The held table has the customers without debt, so that some wanted keys are missing."""
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    held = table(spark, sf, "customer").filter("c_acctbal >= 0")
    return keyed.keys_not_found(held, wanted, "c_custkey")


def _urgent(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(
        F.col("o_orderkey").alias("l_orderkey")
    )


def bloom_semi_join(spark, sf):
    """Lines of urgent large orders; the filter keeps the other lines out of the shuffle."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return bloom.semi_join(lines, _urgent(spark, sf), "l_orderkey")


def bloom_anti_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return bloom.anti_join(lines, _urgent(spark, sf), "l_orderkey")


STAT_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_name"}


def table_stats(spark, sf):
    stats = [keyed.table_stats(n, table(spark, sf, n), k) for n, k in STAT_KEYS.items()]
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out


def set_contains(spark, sf):
    return keyed.set_contains(words_of(spark, sf, "benchmark"), words_of(spark, sf, "conversations"), "word")


def _both_ways(spark, sf, operator):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    w, x = words_of(spark, sf, "benchmark"), words_of(spark, sf, "documents")
    named = {"customer_nation": (a, b), "nation_customer": (b, a), "benchmark_documents": (w, x),
             "documents_benchmark": (x, w), "empty_nation": (keyed.set_clear(b), b)}
    rows = [operator(*pair).select(F.lit(n).alias("pair"), "holds") for n, pair in named.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def set_subset(spark, sf):
    return _both_ways(spark, sf, keyed.set_subset)


def set_equal(spark, sf):
    return _both_ways(spark, sf, keyed.set_equal)


def set_union(spark, sf):
    return keyed.set_union(words_of(spark, sf, "documents"), words_of(spark, sf, "benchmark"))


def set_intersection(spark, sf):
    return keyed.set_intersection(words_of(spark, sf, "documents"), words_of(spark, sf, "benchmark"))


def set_difference(spark, sf):
    return keyed.set_difference(words_of(spark, sf, "documents"), words_of(spark, sf, "benchmark"))


def set_add_remove(spark, sf):
    a, b = words_of(spark, sf, "benchmark"), words_of(spark, sf, "conversations")
    results = {"add": keyed.set_add(a, b), "remove": keyed.set_remove(a, b), "clear": keyed.set_clear(a), "clone": a}
    rows = [d.agg(F.count(F.lit(1)).alias("n_members")).select(F.lit(n).alias("op"), "n_members") for n, d in results.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def djb2_buckets(spark, sf):
    hashed = words_of(spark, sf, "documents").select(hs.bucket_of(hs.djb2(F.col("word")), BUCKETS).alias("bucket"))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_words"))


def knuth_buckets(spark, sf):
    orders = table(spark, sf, "orders").select((hs.knuth32(F.col("o_custkey")) % BUCKETS).alias("bucket"))
    lines = table(spark, sf, "lineitem").select(hs.bucket_of(hs.knuth64(F.col("l_orderkey")), BUCKETS).alias("bucket"))
    both = orders.select(F.lit("int32").alias("kind"), "bucket").unionByName(lines.select(F.lit("int64").alias("kind"), "bucket"))
    return both.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


def sort_int(spark, sf):
    return ordering.sorted_rank(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


def sort_str(spark, sf):
    return ordering.sorted_rank_bytes(table(spark, sf, "part"), "p_name", "p_partkey")


def lehmer_int(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rn.lehmer_int(F.col("doc_id") + 1, SEED).alias("draw"))


def lehmer_uniform(spark, sf):
    drawn = table(spark, sf, "documents").select("doc_id", "lang", rn.lehmer_uniform(F.col("doc_id") + 1, SEED).alias("u"))
    return drawn.select("doc_id", "lang", r6("u").alias("u"), (F.col("u") < 0.8).alias("in_train"))


def lehmer_single(spark, sf):
    drawn = table(spark, sf, "documents").select("doc_id", rn.lehmer_uniform_single(F.col("doc_id") + 1, SEED).alias("u"))
    return drawn.select("doc_id", r6("u").alias("u"))


def _cell_matrix(spark, sf, draw):
    shape = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "x"))
    k = F.col("vec_id") * WIDTH + F.col("col") + 1
    return shape.select(F.col("vec_id").alias("row"), "col", r6(draw(k, WIDTH, WIDTH, SEED)).alias("val"))


def xavier_matrix(spark, sf):
    """A random matrix shaped like the embedding table, each row filled where it lies."""
    return _cell_matrix(spark, sf, rn.xavier)


def muller_matrix(spark, sf):
    return _cell_matrix(spark, sf, rn.muller)


def shuffle(spark, sf):
    return rd.shuffle_rows(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


def shuffle_exchange(spark, sf):
    """The documents in the order of the serial exchange shuffle."""
    return rd.exchange_rows(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], SEED)


QUERIES = {
    f.__name__: f
    for f in (
        first_wins_upsert, keyed_store, counting_upsert, lookup, lookup_nation, delete_keys, delete_not_found, bloom_semi_join, bloom_anti_join, table_stats,
        set_contains, set_subset, set_equal, set_union, set_intersection, set_difference, set_add_remove,
        djb2_buckets, knuth_buckets, sort_int, sort_str, lehmer_int, lehmer_uniform, lehmer_single, xavier_matrix, muller_matrix,
        shuffle, shuffle_exchange,
    )
}

D, B, C = (f"(SELECT word FROM ({words_sql(t)}))" for t in ("documents", "benchmark", "conversations"))
SETS = {
    "customer_nation": ("(SELECT c_nationkey AS k FROM customer)", "(SELECT n_nationkey AS k FROM nation)"),
    "nation_customer": ("(SELECT n_nationkey AS k FROM nation)", "(SELECT c_nationkey AS k FROM customer)"),
    "benchmark_documents": (B, D),
    "documents_benchmark": (D, B),
    "empty_nation": ("(SELECT n_nationkey AS k FROM nation WHERE false)", "(SELECT n_nationkey AS k FROM nation)"),
}
STREAM = (
    "WITH RECURSIVE l(k, x) AS (SELECT 1, (48271::BIGINT * {seed}) % 2147483647 UNION ALL "
    "SELECT k + 1, (x * 48271) % 2147483647 FROM l WHERE k <= (SELECT max(doc_id) FROM documents)) "
).format(seed=SEED)
DJB2 = (
    "list_reduce([5381::HUGEINT] || list_transform(regexp_extract_all(hex(encode(word)), '..'), "
    "lambda h: (CASE WHEN h > '7F' THEN ('0x' || h)::INT - 256 ELSE ('0x' || h)::INT END)::HUGEINT), "
    "lambda a, c: (a * 33 + c + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)"
)
MATRIX = (
    "SELECT vec_id AS row, j AS col, {value} AS val FROM (SELECT vec_id, j, {draws} FROM (SELECT vec_id, j::INT AS j, "
    f"vec_id * {WIDTH} + j + 1 AS k FROM embeddings, range(0, {WIDTH}) r(j)))"
)


def _uniform(k: str) -> str:
    return f"{lehmer_sql(k, SEED)} / 2147483647.0::DOUBLE"


ORACLES = {
    "first_wins_upsert": (
        "WITH held AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_mktsegment = 'BUILDING') "
        "SELECT key, value FROM held UNION ALL SELECT key, value FROM (SELECT o_custkey AS key, o_totalprice AS value, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) "
        "WHERE rn = 1 AND key NOT IN (SELECT key FROM held)"
    ),
    "keyed_store": (
        "WITH held AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_mktsegment = 'BUILDING'), "
        "joined AS (SELECT key, value FROM held UNION ALL SELECT key, value FROM (SELECT o_custkey AS key, o_totalprice AS value, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) "
        "WHERE rn = 1 AND key NOT IN (SELECT key FROM held)) "
        "SELECT c_custkey AS key, c_nationkey, CASE WHEN c_acctbal >= 0 THEN value END AS value "
        "FROM customer LEFT JOIN joined ON key = c_custkey"
    ),
    "counting_upsert": (
        f"SELECT word, sum(freq)::BIGINT AS freq FROM ({words_sql('documents')} UNION ALL "
        f"{words_sql('conversations')}) GROUP BY word"
    ),
    "lookup": "SELECT doc_id, lang, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "lookup_nation": (
        "SELECT c_nationkey, c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"
    ),
    "delete_keys": (
        "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    ),
    "delete_not_found": (
        "SELECT DISTINCT o_custkey AS c_custkey FROM orders "
        "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"
    ),
    **{
        f"bloom_{kind}_join": f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey {word} "
        "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)"
        for kind, word in (("semi", "IN"), ("anti", "NOT IN"))
    },
    "table_stats": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n_rows, count(*) = 0 AS is_empty, "
        f"'{'string' if n == 'part' else 'bigint'}' AS key_type FROM {n}" for n in STAT_KEYS
    ),
    "set_contains": f"SELECT word, word IN {C} AS found FROM {B}",
    "set_subset": " UNION ALL ".join(
        f"SELECT '{n}' AS pair, NOT EXISTS (FROM (SELECT * FROM {a} EXCEPT SELECT * FROM {b})) AS holds"
        for n, (a, b) in SETS.items()
    ),
    "set_equal": " UNION ALL ".join(
        f"SELECT '{n}' AS pair, NOT EXISTS (FROM (SELECT * FROM {a} EXCEPT SELECT * FROM {b})) AND NOT EXISTS "
        f"(FROM (SELECT * FROM {b} EXCEPT SELECT * FROM {a})) AS holds" for n, (a, b) in SETS.items()
    ),
    "set_union": f"SELECT word FROM {D} UNION SELECT word FROM {B}",
    "set_intersection": f"SELECT word FROM {D} INTERSECT SELECT word FROM {B}",
    "set_difference": f"SELECT word FROM {D} EXCEPT SELECT word FROM {B}",
    "set_add_remove": (
        f"SELECT 'add' AS op, count(*) AS n_members FROM (SELECT word FROM {B} UNION SELECT word FROM {C}) UNION ALL "
        f"SELECT 'remove', count(*) FROM (SELECT word FROM {B} EXCEPT SELECT word FROM {C}) UNION ALL "
        f"SELECT 'clear', 0 UNION ALL SELECT 'clone', count(*) FROM {B}"
    ),
    "djb2_buckets": (
        f"SELECT bucket, count(*) AS n_words FROM (SELECT ({DJB2} % {BUCKETS})::BIGINT AS bucket FROM {D}) "
        "GROUP BY bucket"
    ),
    "knuth_buckets": (
        "SELECT kind, bucket, count(*) AS n FROM (SELECT 'int32' AS kind, "
        f"((o_custkey::HUGEINT * 2654435761) % 4294967296 % {BUCKETS})::BIGINT AS bucket FROM orders UNION ALL "
        f"SELECT 'int64', ((l_orderkey::HUGEINT * 2654435761) % 18446744073709551616::HUGEINT % {BUCKETS})::BIGINT "
        "FROM lineitem) GROUP BY kind, bucket"
    ),
    "sort_int": "SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rank FROM orders",
    "sort_str": "SELECT p_name, p_partkey, row_number() OVER (ORDER BY hex(encode(p_name)), p_partkey) AS rank FROM part",
    "lehmer_int": f"{STREAM} SELECT doc_id, x AS draw FROM documents JOIN l ON k = doc_id + 1",
    "lehmer_uniform": (
        f"{STREAM} SELECT doc_id, lang, {q6('x / 2147483647.0::DOUBLE')} AS u, x / 2147483647.0::DOUBLE < 0.8 AS in_train "
        "FROM documents JOIN l ON k = doc_id + 1"
    ),
    "lehmer_single": (
        f"{STREAM} SELECT doc_id, {q6('(x / 2147483647.0::DOUBLE)::FLOAT::DOUBLE')} AS u FROM documents JOIN l ON k = doc_id + 1"
    ),
    "xavier_matrix": MATRIX.format(
        value=q6(f"(2.0 * u - 1.0) * sqrt(6.0::DOUBLE / {2 * WIDTH})"), draws=f"{_uniform('k')} AS u"
    ),
    "muller_matrix": MATRIX.format(
        value=q6(
            "sqrt(-2.0 * ln(greatest(u, 1e-7::DOUBLE))) * cos(2.0 * pi() * greatest(v, 1e-7::DOUBLE)) * "
            f"sqrt(2.0::DOUBLE / {2 * WIDTH})"
        ),
        draws=f"{_uniform('2 * k - 1')} AS u, {_uniform('2 * k')} AS v",
    ),
    "shuffle_exchange": (  # one exchange after the other on a list
        "WITH RECURSIVE d AS (SELECT list(doc_id ORDER BY doc_id) AS a, count(*) AS n FROM documents), "
        f"draws AS MATERIALIZED (SELECT n - k AS i, {lehmer_sql('k', SEED)} % (n - k + 1) AS j "
        "FROM (SELECT n, unnest(range(1, n)) AS k FROM d)), "
        "walk AS (SELECT n - 1 AS i, a FROM d UNION ALL SELECT walk.i - 1, CASE WHEN j = walk.i THEN a ELSE "
        "a[:j] || [a[walk.i + 1]] || a[j + 2:walk.i] || [a[j + 1]] || a[walk.i + 2:] END "
        "FROM walk JOIN draws ON draws.i = walk.i WHERE walk.i > 0) "
        "SELECT doc_id, lang, position FROM (SELECT unnest(a) AS doc_id, generate_subscripts(a, 1)::BIGINT - 1 AS position "
        "FROM walk WHERE i = 0) JOIN documents USING (doc_id)"
    ),
    "shuffle": (
        f"{STREAM} SELECT doc_id, row_number() OVER (ORDER BY x, doc_id) AS position "
        "FROM documents JOIN l ON k = doc_id + 1"
    ),
}
