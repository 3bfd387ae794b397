import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_brute as brute
from lexivec.llm import decontaminate, lines, neardup, suffix
from lexivec.llm.batches import Lookup, mix
from lexivec.llm.components import components
from lexivec.llm.runindex import RunIndex
from lexivec.scratch import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, name string, begin string"


def table(spark, rows, schema=SCHEMA):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, 7, "n", "b") for i, t in rows], schema)


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def corpus(seed=5):
    """Copies, near copies, shared passages, empty, null and very long texts, periodic text, repeated rows."""
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice([3, 8, 40, 120]))) for k in range(40)]
    base = prose(rng, 150)
    for k in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((50 + k, " ".join(w)))
    rows += [(70 + k, base) for k in range(5)]
    passage = prose(rng, 60)
    rows += [(80 + k, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 25)}") for k in range(6)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one two three"), (94, "ONE two Three"), (95, "ab" * 300)]
    rows += [(96, prose(rng, 6000)), (97, "é" * 500 + " ü " + "é" * 450), (98, "x"), (3, rows[3][1]), (None, "no id here at all")]
    return rows


def test_contamination(spark):
    rng = random.Random(1)
    rows = corpus()
    items = [(1, rows[5][1]), (2, "One TWO-three"), (3, None), (4, "..."), (5, " ".join(rows[60][1].split()[20:45])), (6, prose(rng, 30)),
             (5, prose(rng, 12)), (None, " ".join(rows[61][1].split()[:12]))]
    docs = table(spark, rows)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, word string")
    got = decontaminate.digest(decontaminate.contamination(docs, bench)).collect()
    want = brute.contamination(rows, items)
    assert sorted(map(str, ((r[0], r[1], r[2], r[3], r[4]) for r in got))) == sorted(map(str, want))
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert sum(w[2] > 0 for w in want) > 5
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(w[2] == 0 for w in want)


def test_contamination_without_rows(spark):
    docs, bench = table(spark, corpus()), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, bench).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(table(spark, []), bench).count() == 0


def test_contamination_branches_agree(spark, monkeypatch):
    rows = corpus()
    items = [(1, rows[5][1]), (2, rows[45][1])]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(str, decontaminate.digest(decontaminate.contamination(docs, bench)).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    assert sorted(map(str, decontaminate.digest(decontaminate.contamination(docs, bench)).collect())) == one


def test_contamination_is_native(spark):
    docs, bench = table(spark, corpus()), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    plan = decontaminate.digest(decontaminate.contamination(docs, bench))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows), width=width).collect()}
    assert got.pop(None)[1] is None
    assert got == brute.components([r for r in rows if r[0] is not None], width)


def test_near_duplicates_in_a_dense_region(spark):
    rng = random.Random(3)
    base = prose(rng, 200, 5000).split()
    rows = []
    for k in range(60):  # about four in five pairs with the base link, few with one another
        w = list(base)
        for at in rng.sample(range(200), rng.choice([1, 5, 9, 12])):
            w[at] = f"n{k}x{at}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows), width=4).collect()}
    assert got == brute.components(rows, 4)


@pytest.mark.parametrize("block", [40, 256])
def test_near_duplicates_under_the_threshold(spark, monkeypatch, block):
    """A large family whose pairs lie around the threshold, with changes that several of them share, in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    base = prose(rng, 150, 5000).split()
    rows = []
    for k in range(500):
        w = list(base)
        for at in rng.sample(range(0, 150, 5), rng.choice([2, 4, 5, 6, 7])):
            w[at] = f"n{rng.randrange(3)}x{at}"
        rows.append((k, " ".join(w)))
    rows += [(600, rows[3][1]), (None, rows[4][1]), (3, rows[3][1])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows), width=4).collect()}
    assert got.pop(None)[1] is None
    want = brute.components([r for r in rows if r[0] is not None], 4)
    assert got == want and len({c for _, c in want.values()}) > 100


def test_near_duplicates_of_string_ids(spark):
    rows = corpus()
    frame = table(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()}
    want = brute.components([r for r in rows if r[0] is not None], 5)
    assert {i: c for i, c in got.items() if i} == {f"d{i:04d}": f"d{c:04d}" for i, (_, c) in want.items()}


def test_common_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, size=n).astype(np.uint64)) for n in rng.integers(0, 3000, size=30)]
    one, two = np.arange(0, 17), np.arange(11, 30)
    got = neardup.common_shingles(sets, one, two)
    assert all(got[i, j] == len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(one) for j, b in enumerate(two) if a != b)
    assert neardup.common_shingles([np.zeros(0, np.uint64)] * 2, np.array([0]), np.array([1])).tolist() == [[0]]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_proposals_do_not_depend_on_partitions(spark, parts):
    """Neighbours and regions that a partition boundary parts are found."""
    rng = random.Random(6)
    labels = [bytes([0, 0, 0, rng.randrange(2), 0, 0, 0, rng.randrange(3), 0, rng.randrange(2), 0, 1]) for _ in range(20)]
    rows = sorted((tree, label, k, 50) for tree in range(2) for k, label in enumerate(labels))
    orders = spark.createDataFrame(rows, "tree int, label binary, id bigint, n bigint")
    orders = orders.repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    members, pairs = neardup._proposed(orders, 80, "bigint", Scratch(spark, "test"))
    near = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if (x[0], x[1][:8]) == (y[0], y[1][:8])]
    assert sorted((r["tree"], bytes(r["label"]), r["id"], r["n"]) for r in members.collect()) == sorted({r for p in near for r in p})
    assert sorted(tuple(r) for r in pairs.collect()) == sorted({tuple(sorted((x[2], y[2]))) for x, y in near})


def test_near_duplicates_in_partitions_of_one_row(spark):
    rng = random.Random(9)
    base = prose(rng, 120, 5000)
    rows = [(1, base), (2, base + " more"), (3, prose(rng, 50)), (4, base + " more words")]
    settings = {"spark.sql.shuffle.partitions": "128", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = neardup.near_duplicates(table(spark, rows), width=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(rows, 4)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in neardup.near_duplicates(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(tuple(r) for r in components(frame, Scratch(spark, "test"), "c").collect())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(frame.limit(0), Scratch(spark, "test"), "c").count() == 0


def test_lookup():
    keys = mix(np.arange(1, 5000, dtype=np.uint64))
    found = Lookup(keys).find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (found[: len(keys)] == np.arange(len(keys))).all() and (found[len(keys) :] < 0).all()
    assert (Lookup(np.zeros(0, np.uint64)).find(keys) < 0).all()


def test_run_index():
    rng = random.Random(4)
    for _ in range(120):
        strings = [bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"abcd", k=rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
        strings += strings[:1]
        offsets = np.cumsum([0, *map(len, strings)])
        data = np.frombuffer(b"".join(strings), np.uint8)
        index = RunIndex.build(data, offsets)
        assert index.lengths.sum() == len(data)
        at = [s[k:] for s in strings for k in range(len(s))]

        def shared(x, y):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n

        want = [max((shared(x, y) for j, y in enumerate(at) if j != i), default=0) for i, x in enumerate(at)]
        assert index.matches().tolist() == want


@pytest.mark.parametrize("limits", [{}, {"hot": 500}, {"shard": 2000}])
def test_repeated_strings(spark, limits):
    rows = corpus()
    got = suffix.remove_repeats(table(spark, rows), length=100, gram=16, **limits).collect()
    want = brute.without_repeats(rows, 100)
    have = [(r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["begin"], s["end"]) for s in r["spans"]]) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert sum(len(w[3]) for w in want) > 20


def test_long_stretches(spark, monkeypatch):
    rows = [(1, "a" * 3000 + "b"), (2, "xyz" * 700), (3, "c" + "a" * 99)]
    got = suffix.remove_repeats(table(spark, rows), length=100, gram=16).collect()
    have = sorted((r["doc_id"], bytes(r["kept"])) for r in got)
    assert have == sorted((i, k) for i, _, k, _ in brute.without_repeats(rows, 100))


def test_cut_texts_stay_valid(spark):
    rows = corpus()
    docs = table(spark, rows)
    cut = suffix.cut_texts(docs, length=101, gram=16)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert kept[90] is None and kept[91] == "" and kept[70] == ""
    plain = {i: k for i, _, k, _ in brute.without_repeats(rows, 101)}
    assert all(len((kept[i] or "").encode()) - len(plain[i]) in range(0, 7) for i in kept)


def test_digest_of_repeats(spark):
    got = suffix.digest(suffix.remove_repeats(table(spark, corpus()), length=100, gram=16)).collect()
    want = {i: (n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, n, k, s in brute.without_repeats(corpus(), 100)}
    assert all((r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def test_no_documents(spark):
    assert suffix.remove_repeats(table(spark, [])).count() == 0
    assert lines.remove_repeated_units(table(spark, [])).count() == 0


def test_lines(spark):
    rows = [(1, "One two three\nA line that comes again here\n\nshort\n"), (2, "a LINE  that comes\tagain here\r\nrest of this text is new"),
            (3, None), (4, ""), (5, "x\nshort\nA line that comes again here"), (6, "a line that comes again here\na line that comes again here")]
    got = {r["doc_id"]: r for r in lines.remove_repeated_units(table(spark, rows)).collect()}
    assert {i: bytes(r["kept"]).decode() for i, r in got.items()} == {
        1: rows[0][1], 2: "rest of this text is new", 3: "", 4: "", 5: "x\n", 6: ""}
    assert [(s["begin"], s["end"]) for s in got[2]["spans"]] == [(0, 31)]
    assert got[1]["n_units"] == 4 and got[3]["n_units"] == 0
    ranked = lines.remove_repeated_units(table(spark, rows), rank=-F.col("doc_id")).collect()
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in ranked}[6] == "a line that comes again here\n"


@pytest.mark.parametrize("paragraphs", [False, True])
def test_repeated_units_against_a_plain_version(spark, paragraphs):
    """Nulls, empty and very long texts, repeated rows, null ids, short units and units without spaces."""
    rng = random.Random(8)
    pool = ["menu", "one two", "日本語の文章です", "a  Longer LINE of words", "a longer line of words", "", " \t", "x" * 300]
    rows = [(k, "\n".join(rng.choice([*pool, prose(rng, 6)]) for _ in range(rng.randrange(9)))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "\n".join(prose(rng, 8, 30) for _ in range(4000)) + "\nmenu"), (5, rows[5][1])]
    rows += [(None, "menu\nno id"), (80, "first paragraph\nof two lines\n\nsecond\n\n"), (81, "first paragraph of two lines\n\n\nthird\n")]
    units, first = {}, {}
    for row in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (row[1] or "").encode()
        bounds = lines.unit_bounds(body, paragraphs)
        units[row] = [(a, b, b" ".join(body[a:b].lower().split())) for a, b in zip(bounds, bounds[1:], strict=False)]
        for a, _, unit in units[row]:
            first.setdefault(unit, (row, a))
    want = []
    for row in rows:
        gone = [(a, b) for a, b, unit in units[row] if unit and first[unit] != (row, a)]
        kept = b"".join((row[1] or "").encode()[a:b] for a, b, _ in units[row] if (a, b) not in gone)
        want.append((row[0], len(units[row]), len(gone), sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(),
                     ",".join(f"{a}-{b}" for a, b in gone), kept.decode()))
    got = lines.digest(lines.remove_repeated_units(table(spark, rows).repartition(6), paragraphs=paragraphs)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_cut_texts_with_clashing_columns(spark):
    rows = corpus()
    frame = table(spark, rows).select("*", F.lit(5).alias("spans"), F.lit("k").alias("k"), F.lit(1).alias("r"), F.lit(2).alias("kept"))
    out = suffix.cut_texts(frame, length=100, gram=16)
    assert out.columns == frame.columns and out.filter("spans = 5").count() == len(rows)


def test_paragraphs():
    assert lines.unit_bounds(b"a\nb\n\n\nc\n", True) == [0, 6, 8]
    assert lines.unit_bounds(b"a\nb\n\n\nc\n") == [0, 2, 4, 5, 6, 8]
    assert lines.unit_bounds(b"") == [0]
