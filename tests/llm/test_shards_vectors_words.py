"""Sharding, whitening and spelling variants against plain versions on small tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import sharding, spelling, whitening
from lexivec.scratch import Scratch


# --- op11 -----------------------------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    """Residuals of the bins, by looking at all of them."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fitting = [k for k, r in enumerate(bins) if r >= size]
        if fitting:
            bins[min(fitting, key=lambda k: (bins[k], k))] -= size
        else:
            bins.append(max(capacity, size) - size)
    return bins


def loads(sizes, shards):
    out = collections.Counter()
    for size, shard in zip(sizes, shards, strict=True):
        out[shard] += size
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_plain_one(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 2, 3, rng.randrange(1, 700), 1300]) for _ in range(rng.choice([0, 1, 90, 900]))), reverse=True)
    got = sharding.best_fit(sizes, 1000)
    bins = plain_best_fit(sizes, 1000)
    left = loads(sizes, got)
    assert sorted(left.values()) == sorted(c - r for c, r in zip(_capacities(sizes, got, 1000), bins, strict=True))
    fewest = len(bins)
    assert sharding.best_fit(sizes, 1000, fewest) == got
    if fewest:
        assert sharding.best_fit(sizes, 1000, fewest - 1) is None


def _capacities(sizes, shards, capacity):
    """The capacity of each bin in order of opening: a size above it has a bin of its own."""
    first = {}
    for size, shard in zip(sizes, shards, strict=True):
        first.setdefault(shard, max(capacity, size))
    return [first[k] for k in sorted(first)]


def test_tree_finds_the_tightest():
    rng = random.Random(3)
    tree, held = sharding.Residuals(), []
    for turn in range(4000):
        if rng.random() < 0.6 or not held:
            entry = (rng.randrange(500), turn)
            tree.add(entry)
            held.append(entry)
        else:
            room = rng.randrange(520)
            want = min((e for e in held if e[0] >= room), default=None)
            assert tree.take(room) == want
            if want:
                held.remove(want)
    assert max(map(len, tree.leaves)) <= sharding.LEAF


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_even_shards(shards):
    rng = random.Random(shards)
    sizes = sorted((rng.randrange(1, 60) for _ in range(400)), reverse=True)
    got = loads(sizes, sharding.even(sizes, shards))
    assert set(got) == set(range(shards)) and max(got.values()) - sum(sizes) / shards <= 2
    assert sharding.even([], shards) == []
    assert set(sharding.even([900, 900, 1, 1, 1, 1], shards)) <= set(range(shards))
    if shards == 5:  # two sizes above an equal share stand alone, the others share evenly
        got = loads([900, 800, 10, 10, 10, 10, 10, 10], sharding.even([900, 800, 10, 10, 10, 10, 10, 10], 5))
        assert sorted(got.values()) == [20, 20, 20, 800, 900]


DOCS = "doc_id bigint, text string, lang string, size string, shard int, key bigint, part int, place int, bytes int"


def shard_rows(seed=2):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice("abc de fgh") for _ in range(rng.choice([0, 1, 5, 60, 400])))) for k in range(150)]
    rows += [(200 + k, "the same text again and again " * 4) for k in range(120)]
    rows += [(400, None), (401, None), (402, ""), (403, "é" * 5000), (404, "x" * 30000), (None, "no id"), (None, "no id"), (7, rows[7][1])]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "s", 3, 4, 5, 6, 7) for i, t in rows], DOCS)


@pytest.mark.parametrize("partitions", [1, 9])
def test_shards(spark, partitions):
    rows = shard_rows()
    got = sharding.digest(sharding.shard_documents(as_docs(spark, rows).repartition(partitions), shards=16)).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    of_text, slots, sizes = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for r in got:
        of_text[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(16))
    groups = collections.Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    groups = sorted(groups.values(), reverse=True)
    assert sorted(sizes.values()) == sorted(loads(groups, sharding.even(groups, 16)).values())
    # Groups above an equal share stand alone; the others differ by less than two groups.
    alone = [n for n in groups if n > sum(groups) / 16]
    others = sorted(n for n in sizes.values() if n not in alone)
    assert len(others) + len(alone) == 16 and others[-1] - others[0] < 2 * max(n for n in groups if n not in alone)


@pytest.mark.parametrize("capacity", [500, 12_000, 10**9])
def test_capacity(spark, capacity):
    rows = shard_rows(4)
    groups = collections.Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    got = sharding.shard_documents(as_docs(spark, rows), capacity=capacity).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    bins = plain_best_fit(groups.values(), capacity)
    assert len(sizes) == len(bins) and set(sizes) == set(range(len(bins)))
    assert all(n <= capacity or n in groups.values() for n in sizes.values())


def test_districts_and_parcels(spark, monkeypatch):
    """Many districts and few parcels change neither the rules nor, much, the number of shards."""
    rows = shard_rows(5)
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    monkeypatch.setattr(sharding, "WIDE", 3)
    monkeypatch.setattr(sharding, "ITEMS", 64)
    got = sharding.shard_documents(as_docs(spark, rows), capacity=4000).collect()
    sizes, of_text, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        of_text[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(len(sizes))) and len(sizes) <= 2 * -(-total // 4000) + 8


def test_no_documents_to_shard(spark):
    assert sharding.digest(sharding.shard_documents(as_docs(spark, []), shards=16)).collect() == []
    assert sharding.shard_documents(as_docs(spark, [(1, None)]), shards=16).collect()[0]["slot"] == 0
    for wrong in ({}, {"shards": 0}, {"shards": 2, "capacity": 5}):
        with pytest.raises(ValueError):
            sharding.shard_documents(as_docs(spark, []), **wrong)


# --- op12 -----------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, x int, n string, c double, label int"


def as_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 0.5, 2) for i, v in rows], VECTORS)


def plain_whitening(rows, most=4):
    """(vec_id, x) of the valid rows, the covariance of the distinct ones, their sums and number."""
    valid = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(np.float32(e)) for e in v)]
    d = max((len(v) for _, v in valid), default=0)
    xs = [(i, tuple(int(np.floor(256 * float(np.float32(e)))) for e in v) + (0,) * (d - len(v))) for i, v in valid]
    fit = np.array(sorted({x for _, x in xs}), float).reshape(-1, d)
    return xs, fit


@pytest.mark.parametrize("shape", ["full", "flat"])
def test_whitening(spark, shape):
    rng = np.random.default_rng(4)
    body = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12)
    if shape == "flat":  # dimensions that never change, and one that is a copy
        body[:, 5] = 0.25
        body[:, 7] = body[:, 2]
    rows = [(k, [float(np.float32(e)) for e in v]) for k, v in enumerate(body)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])] + [(1000 + k, rows[9][1]) for k in range(200)]
    if shape == "full":
        rows += [(904, [1.0, 2.0]), (905, [])]
    xs, fit = plain_whitening(rows)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whiten(as_vectors(spark, rows).repartition(7)).collect()
    assert len(got) == 4 * len(xs) and {r["n"] for r in got} == {len(fit)}
    assert collections.Counter(r["vec_id"] for r in got) == collections.Counter(i for i, _ in xs for _ in range(4))
    sums = [int(s) for s in fit.sum(axis=0)]
    deviations = collections.Counter((i, sum((len(fit) * e - s) ** 2 for e, s in zip(x, sums, strict=True))) for i, x in xs)
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviations
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    of_id = dict(xs)
    for component in range(1, 5):
        want = {i: (np.array(x) - fit.mean(axis=0)) @ vectors[:, component - 1] / np.sqrt(values[component - 1]) for i, x in of_id.items()}
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == component}
        sign = np.sign(mine[5] * want[5])
        assert all(abs(mine[i] - sign * want[i]) < 1e-8 for i in want)
        share = next(r["explained"] for r in got if r["component"] == component)
        assert abs(share / (values[component - 1] / values.sum()) - 1) < 1e-10


def test_whitening_of_little(spark):
    assert whitening.whiten(as_vectors(spark, [])).collect() == []
    assert whitening.whiten(as_vectors(spark, [(1, None), (2, [None])])).collect() == []
    assert whitening.whiten(as_vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []  # no variance
    assert whitening.whiten(as_vectors(spark, [(1, []), (2, [])])).collect() == []
    two = whitening.whiten(as_vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0])])).collect()  # one direction
    assert [r["component"] for r in two] == [1, 1] and all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in two)
    assert {r["deviation"] for r in two} == {2 * 256**2}


def test_nearly_dependent_columns_need_the_shift(spark):
    """Columns that differ in the last unit: without the shift the first factor would not exist."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 22), 1 << 22, size=(400, 1))
    x = np.hstack([base, base + rng.integers(0, 2, size=(400, 1)), base * 2 + rng.integers(0, 2, size=(400, 1))])
    rows = spark.createDataFrame([(bytes(r.astype("<i8").tobytes()),) for r in x], "x binary")
    fit = whitening.fit_components(rows, 3)
    unique = np.unique(x, axis=0)
    s = np.linalg.svd(unique - unique.mean(axis=0), compute_uv=False)
    assert np.allclose(fit.values[0], s[0] ** 2 / fit.n, rtol=1e-10)
    assert np.allclose(fit.vectors.T @ fit.vectors, np.eye(fit.vectors.shape[1]), atol=1e-12)


def test_deviations_beyond_a_long():
    x = np.array([[3, -5], [1 << 40, 7], [1 << 60, 1]], np.int64)
    sums = [int(v) for v in x.sum(axis=0)]
    want = [sum((3 * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 3, sums) == [w if w < 1 << 63 else None for w in want]
    assert whitening.deviations(x[:1], 3, [9, -15]) == [0]


# --- op13 -----------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    front = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[front:], b[front:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:]


def plain_variants(docs):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in v.items():
        near = [o for o in v if one_edit(w, o)]
        best = min(near, key=lambda o: (-v[o], o), default=None)
        form = best if best is not None and v[best] >= 5 * n else None
        out[w] = [form, w, n, len(near), v.get(form)]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {(w, *rest) for w, rest in out.items()}


def spelled(seed=1):
    """Families of words: chains of forms, ties, edits at every place, capitals, accents, one very common word."""
    rng = random.Random(seed)
    letters = "abcdeé×ÿ"
    rows, words = [], []
    for _ in range(25):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 14)))
        words += [word] * 130
        for times in (26, 5, 5, 6):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2) :]
            words += [other] * times
            word = other if rng.random() < 0.5 else word
    words += ["aaaaaa"] * 4000 + ["AAAAAAA"] * 700 + ["aaaaaaaa"] * 100 + ["Éaaaaaa"] * 9 + ["short"] * 50 + ["Straße"] * 40 + ["Strasse"] * 40
    rng.shuffle(words)
    for k in range(0, len(words), 40):
        rows.append((k, f"1{rng.choice(' .-_,')}".join(words[k : k + 40])))
    rows += [(5000, None), (5001, ""), (5002, " 123 \n"), (None, "aaaaaa aaaaab " * 30), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(5003, "bbbbbb " * 30000 + "bbbbbc " * 300), (5004, "c" * 200_000)]
    return rows


def test_variants(spark):
    rows = spelled()
    table = spark.createDataFrame([(i, t, "w", 1, "f", 2) for i, t in rows], "doc_id bigint, text string, word string, n int, form string, m int")
    got = spelling.group_variants(table.repartition(5)).collect()
    want = plain_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[1] is not None for w in want) > 30 and any(w[2] != w[0] and w[2] != w[1] for w in want)


@pytest.mark.parametrize("block", [2, 7])
def test_parts_of_blocks(spark, block):
    """Cutting blocks into parts changes nothing."""
    rng = random.Random(block)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(400)})
    counts = {w: rng.randrange(5, 12) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r["word"]: tuple(r)[1:] for r in spelling.near_summary(frame, Scratch(spark, "test"), block).collect()}
    want = {}
    for w in words:
        near = [o for o in words if one_edit(w, o)]
        if near:
            best = min(near, key=lambda o: (-counts[o], o))
            want[w] = (len(near), best, counts[best])
    assert got == want


def test_scan_of_a_sorted_list():
    rng = random.Random(9)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abcÿ") for _ in range(rng.randrange(0, 9))) for _ in range(70)})
        prefixes = spelling.adjacent_prefixes(words)
        for query in [*words[:15], "abcab", ""]:
            assert spelling.near_words(query, words, prefixes, 0) == [k for k, w in enumerate(words) if one_edit(query, w)]


def test_no_words(spark):
    schema = "doc_id bigint, text string"
    assert spelling.group_variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "few words")], schema)).collect() == []


def test_links_to_roots(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [(f"x{k}", "w3") for k in range(300)], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(links, Scratch(spark, "test")).collect()}
    assert got == {w: "w20" for w in got} and len(got) == 320
    assert spelling.roots(links.filter(F.lit(False)), Scratch(spark, "test")).count() == 0
