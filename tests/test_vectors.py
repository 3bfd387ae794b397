import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.functions import formats as fm
from lexivec.functions import vectors as vx
from lexivec.operators import blocks, learn, linear, quant
from lexivec.operators import random as rd

PROBE = [0.0, 1.0, 0.1, -1.5, 65504.0, 65536.0, 70000.0, 1e-6]
CODES = {
    "e8m23": [0x0, 0x3F800000, 0x3DCCCCCD, 0xBFC00000, 0x477FE000, 0x47800000, 0x4788B800, 0x358637BD],
    "e5m10": [0x0, 0x3C00, 0x2E66, 0xBE00, 0x7BFF, 0x7C00, 0x7C45, 0x31],
    "e8m7": [0x0, 0x3F80, 0x3DCC, 0xBFC0, 0x477F, 0x4780, 0x4788, 0x3586],
    "e4m3": [0x0, 0x38, 0x1C, 0xBC, 0x78, 0x78, 0x78, 0x0],
}


def vectors(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id int, embedding array<float>")


def bits(codes, fmt):
    """Stored codes are signed; their bit patterns are not."""
    return [c % (1 << (8 * fm.FORMATS[fmt].bytes)) for c in codes]


@pytest.mark.parametrize("fmt", CODES)
def test_scalar_codes(spark, fmt):
    rows = quant.quantized(vectors(spark, PROBE, None), fmt).orderBy("vec_id").collect()
    assert bits(rows[0]["code"], fmt) == CODES[fmt] and rows[1]["code"] is None


def test_fp8_edges(spark):
    frame = vectors(spark, [240.0, 256.0, 300.0, 448.0, 0.0076, -1e9])
    coded = quant.quantized(frame, "e4m3")
    assert bits(coded.first()["code"], "e4m3") == [0x77, 0x78, 0x79, 0x7E, 0x07, 0xF8]
    back = quant.dequantized(coded, "e4m3").first()["vec"]
    assert back[0] == 240.0 and back[1] == math.inf and math.isnan(back[2]) and back[5] == -math.inf


def test_half_overflow_decodes_as_nan(spark):
    back = quant.dequantized(quant.quantized(vectors(spark, PROBE), "e5m10"), "e5m10").first()["vec"]
    assert back[5] == math.inf and math.isnan(back[6]) and back[4] == 65504.0


def test_q8_goldens(spark):
    zeros = [0.0] * 5
    frame = vectors(spark, [0.5, -0.25, 0.1, *zeros], [3.0, 1.0, -1.9, *zeros], [0.0] * 8, [2.0**k for k in range(8)])
    rows = quant.quantized(frame, "q8").orderBy("vec_id").collect()
    assert (rows[0]["code"]["w"], rows[0]["code"]["q"][:3]) == ([-7], [64, -32, 13])
    assert (rows[1]["code"]["w"], rows[1]["code"]["q"][:3]) == ([-6], [127, 64, -122])
    assert rows[2]["code"]["w"] == [0] and rows[2]["code"]["q"] == [0] * 8
    back = quant.dequantized(quant.quantized(frame, "q8"), "q8").orderBy("vec_id").collect()
    assert back[1]["vec"][0] == 1.984375


def test_q8_refuses_odd_lengths_and_scalar_path(spark):
    with pytest.raises(Exception, match="multiple of the block"):
        quant.quantized(vectors(spark, [1.0] * 9), "q8").collect()
    with pytest.raises(ValueError):
        fm.encode_scalar("q8")


def test_ragged_vectors_are_refused(spark):
    with pytest.raises(Exception, match="elements in one column"):
        quant.quantized(vectors(spark, [1.0], [1.0, 2.0]).coalesce(1), "e8m7").collect()


def test_quant_error_skips_values_that_do_not_come_back(spark):
    frame = vectors(spark, [1.0, 300.0] + [0.0] * 6).withColumn("g", F.lit(1))
    rows = {r["format"]: r for r in quant.quant_error(frame, "g").collect()}
    assert rows["e8m23"]["max_error"] == 0.0 and rows["e4m3"]["n_finite"] == 7 and rows["e8m7"]["n_finite"] == 8


def test_softmax_of_one_and_ties(spark):
    frame = vectors(spark, [5.0], [2.0, 7.0, 7.0])
    rows = frame.orderBy("vec_id").select(vx.softmax(F.col("embedding")).alias("p")).collect()
    assert rows[0]["p"] == [1.0] and abs(sum(rows[1]["p"]) - 1) < 1e-12
    best = linear.top_k(frame, "vec_id", "embedding", 1).orderBy("vec_id").collect()
    assert [(r["idx"], r["val"]) for r in best] == [(0, 5.0), (1, 7.0)]


def test_close(spark):
    rows = [(1.0, 1.0, True), (1.0, 1.005, True), (1.0, 1.02, False), (math.nan, math.nan, False),
            (math.inf, math.inf, True), (math.inf, -math.inf, False), (math.inf, 1.0, False)]
    frame = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert frame.filter(vx.close(F.col("a"), F.col("b"), 2) != F.col("want")).count() == 0


def test_activation_values(spark):
    frame = spark.createDataFrame([(0.0,), (-2.0,), (3.0,)], "x double")
    for x, r, d in frame.select("x", vx.relu(F.col("x")), vx.relu_prime(F.col("x"))).collect():
        assert r == max(x, 0.0) and d == (1.0 if x > 0 else 0.0)
    step = 1e-6
    for f, g in ((vx.silu, vx.silu_prime), (vx.sigmoid, vx.sigmoid_prime)):
        gap = (f(F.col("x") + step) - f(F.col("x") - step)) / (2 * step) - g(F.col("x"))
        assert frame.select(F.max(F.abs(gap))).first()[0] < 1e-8


def test_matmul_paths_agree(spark):
    frame = vectors(spark, [1.0, 2.0, 3.0], [0.5, -1.0, 0.0])
    cells = rd.xavier_matrix(spark, 4, 3, 9)
    a = {(r[0], r[1]): r[2] for r in linear.matmul(frame, cells, "vec_id", "embedding").collect()}
    b = {(r[0], r[1]): r[2] for r in linear.matmul_by_join(frame, cells, "vec_id", "embedding").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_scoring_blocks_agree(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 6)).astype(np.float32)
    frame = vectors(spark, *data.tolist()).repartition(5)
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(7)], "qid int, embedding array<double>")
    read = lambda d: sorted((r["qid"], r["rank"], r["vec_id"]) for r in d.collect())
    small = read(linear.tied_scoring(frame, queries, "vec_id", "embedding", "qid", 4))
    assert read(linear.tied_scoring(frame, queries, "vec_id", "embedding", "qid", 4, block_cells=10)) == small
    x = data.astype(np.float64)
    for q in range(7):
        scores = x @ (x[q] / np.sqrt((x[q] ** 2).mean() + 1e-6))
        best = np.lexsort((np.arange(300), -scores))[:4]
        assert [v for i, _, v in small if i == q] == best.tolist()


def test_dealt_scoring_agrees_and_keeps_no_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(size=(290, 6)), np.ones((10, 6))]).astype(np.float32)  # with ties
    frame = vectors(spark, *data.tolist()).repartition(5)
    queries = spark.createDataFrame([(f"q{i}", data[i].tolist()) for i in range(0, 300, 7)], "qid string, embedding array<double>")
    read = lambda d: sorted((r["qid"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in d.collect())
    small = read(linear.tied_scoring(frame, queries, "vec_id", "embedding", "qid", 4))
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 100)  # several bundles
    assert read(linear.tied_scoring(frame, queries, "vec_id", "embedding", "qid", 4, block_cells=12, broadcast_cells=0)) == small
    batch = pa.array(np.zeros(1 << 17))
    leaders = blocks._Leaders(batch.slice(5, 2), np.zeros((4, 3))[1:3], 4, "k")
    assert leaders.names.get_total_buffer_size() < 1000 and leaders.queries.base is None  # of a batch of 1 MB, two rows


@pytest.mark.parametrize("block", [1, 4, 8, 100])
def test_attention_over_blocks_and_brute_force(spark, block):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(21, 8))
    frame = spark.createDataFrame([(i, 0, data[i].tolist()) for i in range(21)], "vec_id int, g int, x array<double>")
    rows = linear.sequence_positions(frame, "g", "vec_id").select(
        "g", "pos", "vec_id", F.col("x").alias("q"), F.slice("x", 1, 4).alias("k"), F.slice("x", 5, 4).alias("v")
    )
    found = {r["vec_id"]: r["out"] for r in linear.causal_attention(rows, ["g"], "vec_id", 4, 2, block=block).collect()}
    assert len(found) == 21
    turn = lambda v, p: np.array([v[0] * np.cos(p) - v[1] * np.sin(p), v[0] * np.sin(p) + v[1] * np.cos(p)])
    for i in range(21):
        first = 0
        for h in range(4):
            q = turn(data[i, 2 * h : 2 * h + 2], i - first)
            c = h // 2
            ks = [turn(data[t, 2 * c : 2 * c + 2], t - first) for t in range(first, i + 1)]
            w = np.exp([q @ k / math.sqrt(2) for k in ks])
            out = sum(a * data[t, 4 + 2 * c : 6 + 2 * c] for a, t in zip(w / w.sum(), range(first, i + 1)))
            assert np.allclose(out, found[i][2 * h : 2 * h + 2])


def test_attention_of_groups_keeps_later_values_out(spark):
    """Several groups of queries give what one gives, and a value that is not finite reaches no position before it."""
    data = np.random.default_rng(5).normal(size=(23, 8))
    data[20, 5] = np.inf
    frame = spark.createDataFrame([(i, i, 0, data[i].tolist()) for i in range(23)], "vec_id int, pos long, g int, x array<double>")
    finite = F.transform("x", lambda x: F.when(F.abs(x) < 1e9, x).otherwise(0.0))
    rows = frame.select("g", "pos", "vec_id", finite.alias("q"), F.slice("x", 1, 4).alias("k"), F.slice("x", 5, 4).alias("v"))
    read = lambda **k: np.array([r["out"] for r in linear.causal_attention(rows, ["g"], "vec_id", 4, 2, **k).orderBy("vec_id").collect()])
    one, more = read(block=3), read(block=3, group=2)
    assert np.isfinite(one[:20]).all() and np.isinf(one[20:, 1]).all() and np.isfinite(one[20:, 0]).all()
    assert np.allclose(one, more)


def test_softmax_by_group_sums_to_one(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.sin("id").alias("v"))
    sums = linear.softmax_by_group(frame, "g", "id", "v").groupBy("g").agg(F.sum("p").alias("s"), F.count("p").alias("n"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums.collect()) and sums.agg(F.sum("n")).first()[0] == 1000


def test_cross_entropy_without_target_is_zero(spark):
    frame = spark.createDataFrame([([0.2, 0.8], [0.0, 0.0]), ([0.0, 1.0], [1.0, 0.0])], "p array<double>, y array<double>")
    losses = [r[0] for r in frame.select(vx.cross_entropy(F.col("p"), F.col("y"))).collect()]
    assert losses[0] == 0.0 and abs(losses[1] + math.log(1e-8)) < 1e-9


def test_finite_guard(spark):
    frame = vectors(spark, [1.0, math.nan], [math.inf, 2.0])
    row = learn.finite_guard(frame, ["embedding"]).first()
    assert (row["n"], row["n_nan"], row["n_inf"], row["ok"]) == (4, 1, 1, False)
    with pytest.raises(ValueError):
        learn.require_finite(frame, ["embedding"])


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(3, 5)) * 3
    rows = [(int(i % 3), (centers[i % 3] + rng.normal(size=5)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "label int, vec array<double>").repartition(4)
    _, history = learn.train_classifier(frame, "label", "vec", 3, rd.xavier_matrix(spark, 3, 5, 1), 8, 0.1)
    losses = [r["mean_loss"] for r in history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0] / 2 and all(b <= a for a, b in zip(losses, losses[1:]))


def test_shape_and_clamp(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "vec_id int, embedding array<float>")
    shapes = {r["width"]: r["matches"] for r in linear.shape_check(frame, "embedding", 2).collect()}
    assert shapes == {2: True, 1: False, None: False}
    row = linear.clamp_report(spark.createDataFrame([(1.0,), (9.0,)], "x double"), {"x": (5, 2)}).first()
    assert (row["n_changed"], row["min_after"], row["max_after"], row["midpoint"]) == (2, 2.0, 5.0, 3.5)


def test_gradients_skip_missing_vectors(spark):
    rows = [(1, [1.0, 2.0], [3.0]), (2, None, [4.0]), (3, [5.0, 6.0], None), (4, [0.5, 0.5], [2.0])]
    frame = spark.createDataFrame(rows, "k int, d array<double>, x array<double>")
    cells = {(r["i"], r["j"]): r["g"] for r in learn.outer_gradient(frame, "d", "x").collect()}
    assert cells == {(0, 0): 4.0, (1, 0): 7.0}
    back = {r["k"]: r["dz"] for r in learn.chain_gradient(frame, np.array([[1.0], [2.0]]), "k", "d", "x").collect()}
    assert back[2] is None and back[3] is None
    gate = 1 / (1 + math.exp(-3.0))
    assert abs(back[1][0] - 5.0 * gate * (1 + 3.0 * (1 - gate))) < 1e-12
