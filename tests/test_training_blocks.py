"""Training with the model as a table, against the form that holds it on the driver."""

import numpy as np
import pytest

from lexivec.operators import learn, learn_blocks
from lexivec.operators import random as rd
from lexivec.scratch import Scratch
from lexivec.sources import tables

CLASSES, WIDTH = 7, 11


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), rng.normal(k - 3, 1.0, WIDTH).tolist(), "x") for k in rng.integers(0, CLASSES, 300)]
    rows += [(None, [0.0] * WIDTH, "y"), (2, None, "z"), (CLASSES + 3, [0.5] * WIDTH, "no class"), (-1, [0.25] * WIDTH, "no class")]
    return spark.createDataFrame(rows, "label int, vec array<double>, part string").repartition(5)


def matrix(weights):
    out = np.full((CLASSES, WIDTH), np.nan)
    for i, j, w in weights.collect():
        assert np.isnan(out[i, j])
        out[i, j] = w
    return out


SETTINGS = {"epochs": 3, "lr": 0.2, "decay": 0.01, "momentum": 0.8}


@pytest.mark.parametrize("block_cells, broadcast_cells", [(9, 0), (1 << 18, 1 << 22)])
def test_same_model(spark, frame, block_cells, broadcast_cells):
    initial = rd.xavier_matrix(spark, CLASSES, WIDTH, 3)
    one, history = learn.train_classifier(frame, "label", "vec", CLASSES, initial, **SETTINGS)
    two, steps = learn_blocks.train_classifier(
        frame, "label", "vec", CLASSES, initial, **SETTINGS, block_cells=block_cells, broadcast_cells=broadcast_cells
    )
    assert np.allclose(matrix(one), matrix(two), atol=1e-10)
    a, b = sorted(history.collect()), sorted(steps.collect())
    assert [(r[0], r[3]) for r in a] == [(r[0], r[3]) for r in b] and np.allclose([r[1:3] for r in a], [r[1:3] for r in b], atol=1e-6)


def test_training_goes_on_from_the_last_epoch(spark, frame):
    initial, path = rd.xavier_matrix(spark, CLASSES, WIDTH, 3), Scratch(spark, "test").path("model")
    whole, history = learn_blocks.train_classifier(frame, "label", "vec", CLASSES, initial, **SETTINGS)
    for epochs in (1, 3, 3):
        part, steps = learn_blocks.train_classifier(frame, "label", "vec", CLASSES, initial, **SETTINGS | {"epochs": epochs}, path=path)
        assert tables.table_versions(spark, f"{path}/model")[-1] == epochs + 1 and steps.count() == epochs
    assert np.allclose(matrix(part), matrix(whole), atol=1e-12)
    assert np.allclose([r[1] for r in sorted(steps.collect())], [r[1] for r in sorted(history.collect())], atol=1e-12)


def test_more_cells_than_a_task_may_hold(spark, frame, monkeypatch):
    """Above the limit of the driver form the table form trains."""
    initial = rd.xavier_matrix(spark, CLASSES, WIDTH, 3)
    want = matrix(learn.train_classifier(frame, "label", "vec", CLASSES, initial, 2, 0.1)[0])
    monkeypatch.setattr("lexivec.operators.linear.MODEL_CELLS", 10)
    with pytest.raises(ValueError, match="exceeds"):
        learn.train_classifier(frame, "label", "vec", CLASSES, initial, 2, 0.1)
    got, _ = learn_blocks.train_classifier(frame, "label", "vec", CLASSES, initial, 2, 0.1, block_cells=16, broadcast_cells=0)
    assert np.allclose(matrix(got), want, atol=1e-10)


def test_stops_and_refusals(spark, frame):
    initial = rd.xavier_matrix(spark, CLASSES, WIDTH, 3)
    weights, history = learn_blocks.train_classifier(frame, "label", "vec", CLASSES, initial, 5, 0.1, stop_loss=100.0)
    assert history.count() == 1 and np.allclose(matrix(weights), matrix(initial.selectExpr("int(row) i", "col j", "val w")))
    with pytest.raises(ValueError, match="more than 3 classes"):
        learn_blocks.train_classifier(frame, "label", "vec", 3, initial, 1, 0.1)
    with pytest.raises(ValueError, match="no row"):
        learn_blocks.train_classifier(frame.limit(0), "label", "vec", CLASSES, initial, 1, 0.1)
    with pytest.raises(Exception, match="not finite"):
        bad = frame.selectExpr("label", "array_repeat(double('nan'), 11) vec")
        learn_blocks.train_classifier(bad, "label", "vec", CLASSES, initial, 1, 0.1)
