"""Products and scoring in blocks: every form against numpy, and plans that do not grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import linear


def frame_of(spark, data, kind="double"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], f"k bigint, v array<{kind}>")


def cells_of(spark, matrix):
    return spark.createDataFrame([(i, j, float(matrix[i, j])) for i, j in np.argwhere(matrix).tolist()], "row int, col int, val double")


@pytest.mark.parametrize("block_cells, broadcast_cells", [(30, 0), (400, 0), (4, 1 << 22), (1 << 18, 1 << 22)])
def test_product(spark, block_cells, broadcast_cells):
    """One block, several rows of blocks, several columns of blocks; broadcast and dealt."""
    rng = np.random.default_rng(block_cells)
    data, matrix = rng.normal(size=(83, 17)), rng.normal(size=(23, 17)) * (rng.random((23, 17)) < 0.3)
    matrix[22, 16] = 1.0  # the last cell tells the shape
    table = frame_of(spark, data).unionByName(spark.createDataFrame([(900, None)], "k bigint, v array<double>")).repartition(5)
    got = linear.matmul(table, cells_of(spark, matrix), "k", "v", block_cells, broadcast_cells).collect()
    out = np.full((83, 23), np.nan)
    for k, row, val in got:
        assert np.isnan(out[k, row])
        out[k, row] = val
    assert len(got) == 83 * 23 and np.allclose(out, data @ matrix.T, atol=1e-12)


@pytest.mark.parametrize("broadcast_cells", [0, 1 << 22])
def test_sparse_product(spark, broadcast_cells):
    rng = np.random.default_rng(5)
    data, matrix = rng.normal(size=(40, 3)), np.array([[1.0, 0, 2], [0, 0, 0], [0, 3, 0], [0, 0, 4]])
    got = linear.matmul_by_join(frame_of(spark, data), cells_of(spark, matrix), "k", "v", broadcast_cells).collect()
    assert len(got) == 40 * 3 and all(abs(val - data[k] @ matrix[row]) < 1e-12 for k, row, val in got)


def test_repeated_cells_and_single_precision(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 1.0)], "row int, col int, val double")
    table = spark.createDataFrame([("a", [2.0, 5.0]), ("a", [2.0, 5.0]), (None, [1.0, None])], "k string, v array<float>")
    got = sorted(map(str, map(tuple, linear.matmul(table, cells, "k", "v").collect())))
    assert got == sorted(map(str, [("a", 0, 6.0), ("a", 1, 5.0)] * 2 + [(None, 0, float("nan")), (None, 1, float("nan"))]))
    with pytest.raises(ValueError, match="no cells"):
        linear.matmul(table, cells.limit(0), "k", "v")


def test_matrix_beyond_a_task(spark, monkeypatch):
    monkeypatch.setattr(linear, "MODEL_CELLS", 3)
    with pytest.raises(ValueError, match="exceeds"):
        linear.small_matrix(cells_of(spark, np.eye(2)))


def plain_scoring(data, queries, k):
    out = {}
    for q, wanted in enumerate(queries):
        scores = data @ (wanted / np.sqrt((wanted**2).mean() + 1e-6))
        out[q] = np.lexsort((np.arange(len(data)), -scores))[:k].tolist()
    return out


@pytest.mark.parametrize("block_cells, broadcast_cells", [(7, 0), (100, 1 << 22), (1 << 18, 1 << 22)])
def test_scoring(spark, block_cells, broadcast_cells):
    rng = np.random.default_rng(block_cells)
    data = rng.normal(size=(400, 5)) * rng.choice([0.1, 1, 8], size=(400, 1))
    data[50:60] = data[40:50]  # ties
    queries = rng.normal(size=(31, 5))
    table, asked = frame_of(spark, data).repartition(6), frame_of(spark, queries).withColumnRenamed("k", "q")
    got = linear.tied_scoring(table, asked, "k", "v", "q", 4, block_cells, broadcast_cells).collect()
    found = {q: [r["k"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] for q in range(31)}
    assert found == plain_scoring(data, queries, 4)


def test_norm_bounds_skip_blocks(spark):
    """Vectors of falling length in one task: once there are k good rows, short vectors are not multiplied."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(2000, 8)) * np.exp(-np.arange(2000) / 200)[:, None]
    table, asked = frame_of(spark, data).coalesce(1), frame_of(spark, rng.normal(size=(20, 8))).withColumnRenamed("k", "q")
    met, skipped = linear.scoring_skips(table, asked, "k", "v", "q", 3, 160).first()
    assert met == 20 * 100 and skipped > met / 2
    assert tuple(linear.scoring_skips(table.limit(0), asked, "k", "v", "q", 3).first()) == (0, 0)


def test_scores_that_are_no_numbers(spark):
    table = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [1.0, 1.0]), (4, None)], "k int, v array<double>")
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "q int, v array<double>")
    assert [(r["q"], r["k"], r["rank"]) for r in linear.tied_scoring(table, asked, "k", "v", "q", 2).collect()] == [(7, 3, 1)]
    with pytest.raises(Exception, match="elements meet queries"):
        linear.tied_scoring(table, asked.select("q", F.array(F.lit(1.0)).alias("v")), "k", "v", "q", 2).collect()


def test_plans_do_not_grow(spark):
    """The plan is the same for one block and for many, and no block is a constant of it."""
    rng = np.random.default_rng(1)
    table = frame_of(spark, rng.normal(size=(20, 8)))

    def size(frame):
        return len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines())

    few, many = (frame_of(spark, rng.normal(size=(n, 8))).withColumnRenamed("k", "q") for n in (2, 500))
    assert size(linear.tied_scoring(table, few, "k", "v", "q", 2, 16)) == size(linear.tied_scoring(table, many, "k", "v", "q", 2, 16))
    small, large = (cells_of(spark, rng.normal(size=(n, 8))) for n in (4, 300))
    assert size(linear.matmul(table, small, "k", "v", 64)) == size(linear.matmul(table, large, "k", "v", 64))
