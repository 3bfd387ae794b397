from decimal import Decimal

from pyspark.sql import functions as F

from lexivec.functions import hashing as hs
from lexivec.functions import random as rn
from lexivec.operators import keyed, ordering
from lexivec.operators import random as rd


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_set_algebra(spark):
    a, b, none = numbers(spark, 1, 2, 3), numbers(spark, 2, 3, 4), numbers(spark, 1).limit(0)
    values = lambda d: sorted(r["v"] for r in d.collect())
    holds = lambda d: d.first()["holds"]
    assert values(keyed.set_union(a, b)) == [1, 2, 3, 4]
    assert values(keyed.set_intersection(a, b)) == [2, 3]
    assert values(keyed.set_difference(a, b)) == [1]
    assert values(keyed.set_difference(a, none)) == [1, 2, 3]
    assert holds(keyed.set_subset(keyed.set_intersection(a, b), keyed.set_union(a, b)))
    assert holds(keyed.set_subset(none, a)) and not holds(keyed.set_subset(a, none))
    assert not holds(keyed.set_equal(a, b)) and holds(keyed.set_equal(a, a.union(a)))


def test_keyed_table(spark):
    table = spark.createDataFrame([("alpha", 1), ("beta", 2), ("gamma", 3)], "key string, value int")
    batch = spark.createDataFrame([("alpha", 111, 0), ("delta", 5, 2), ("delta", 4, 1)], "key string, value int, at int")
    after = {r["key"]: r["value"] for r in keyed.first_wins_upsert(table, batch, "key", "value", "at").collect()}
    assert after == {"alpha": 1, "beta": 2, "gamma": 3, "delta": 4}
    gone = spark.createDataFrame([("beta",), ("nope",)], "key string")
    assert {r["key"] for r in keyed.delete_keys(table, gone, "key").collect()} == {"alpha", "gamma"}
    assert [r["key"] for r in keyed.keys_not_found(table, gone, "key").collect()] == ["nope"]
    found = {r["key"]: r["value"] for r in keyed.lookup(gone, table, "key").collect()}
    assert found == {"beta": 2, "nope": None}


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    names = spark.createDataFrame([(7, "hot"), (3, "cold")], "k bigint, name string")
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        found = keyed.lookup(rows, names, "k")
        assert found.count() == 3000 and found.filter("name = 'hot'").count() == 2000


def test_hash_goldens(spark):
    words = {"": 5381, "a": 177670, "hello": 210714636441, "é": 5857809, "the quick brown fox": 1029597298437440792}
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    djb2 = hs.djb2(F.col("w"))
    for r in frame.select("w", hs.hash_value(djb2).alias("h"), hs.bucket_of(djb2, 64).alias("b")).collect():
        assert r["h"] == Decimal(words[r["w"]]) and r["b"] == words[r["w"]] % 64
    keys = spark.createDataFrame([(k,) for k in (1, 2, 1500, -1, 6000)], "k bigint")
    k32 = {r[0]: r[1] for r in keys.select("k", hs.knuth32(F.col("k")).alias("h")).collect()}
    assert [k32[k] for k in (1, 2, 1500, -1)] == [2654435761, 1013904226, 218958108, 1640531535]
    k64 = {r[0]: int(r[1]) for r in keys.select("k", hs.hash_value(hs.knuth64(F.col("k"))).alias("h")).collect()}
    assert [k64[k] for k in (1, 6000, -1)] == [2654435761, 15926614566000, 18446744071055115855]


def test_long_djb2_wraps(spark):
    h = 5381
    for b in b"z" * 4000:
        h = (h * 33 + b) % 2**64
    frame = spark.createDataFrame([("z" * 4000,)], "w string")
    assert frame.select(hs.hash_value(hs.djb2(F.col("w")))).first()[0] == Decimal(h)


def test_lehmer_goldens(spark):
    draws = [r[0] for r in spark.range(1, 6).select(rn.lehmer_int(F.col("id"), 1337)).collect()]
    assert draws == [64538327, 1478294467, 18110394, 180984445, 336668599]
    assert spark.range(10000, 10001).select(rn.lehmer_int(F.col("id"), 1)).first()[0] == 399268537
    default = spark.range(1, 2).select(rn.lehmer_int(F.col("id"), -5), rn.lehmer_int(F.col("id"))).first()
    assert default[0] == default[1]


def test_shuffle_is_a_permutation_independent_of_partitions(spark):
    one = {r["id"]: r["position"] for r in rd.shuffle_rows(spark.range(500).repartition(1), "id", 7).collect()}
    many = {r["id"]: r["position"] for r in rd.shuffle_rows(spark.range(500).repartition(13), "id", 7).collect()}
    assert one == many and sorted(one.values()) == list(range(1, 501))


def test_global_rank_in_groups_with_null_group(spark):
    rows = [(None if i % 3 else i % 2, i) for i in range(200)]
    frame = spark.createDataFrame(rows, "g int, v int").repartition(9)
    found = {}
    for r in ordering.global_rank(frame, ["v"], ["g"]).collect():
        found.setdefault(r["g"], []).append((r["v"], r["rank"]))
    assert sum(map(len, found.values())) == 200
    for pairs in found.values():
        assert [rank for _, rank in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_byte_order_sort(spark):
    frame = spark.createDataFrame([(1, "b"), (2, "B"), (3, "é"), (4, "")], "id int, s string")
    ranks = {r["s"]: r["rank"] for r in ordering.sorted_rank_bytes(frame, "s", "id").collect()}
    assert ranks == {"": 1, "B": 2, "b": 3, "é": 4}


def test_random_matrix_rows(spark):
    rows = rd.matrix_rows(rd.xavier_matrix(spark, 4, 5, 3)).orderBy("row").collect()
    flat = [v for r in rows for v in r["vec"]]
    direct = [r["val"] for r in rd.xavier_matrix(spark, 4, 5, 3).orderBy("row", "col").collect()]
    assert flat == direct and max(map(abs, flat)) <= (6 / 9) ** 0.5
