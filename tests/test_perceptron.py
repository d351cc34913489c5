"""Perceptrons: gradients, what a step costs, and what they learn."""

import numpy as np
import pytest
from conftest import training_frame
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from gleanery.models import perceptron
from gleanery.models.bank import CLASSIFIERS, REGRESSORS, spec
from gleanery.models.base import context_of
from gleanery.plans import training


@pytest.mark.parametrize("classes", [False, True])
def test_gradient_is_the_slope_of_the_loss(classes):
    rng, layers = np.random.default_rng(3), [3, 5, 4, 2 if classes else 1]
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    flat = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    found = perceptron._gradient(x, y, flat, layers, classes)
    for i in rng.choice(len(flat), 12, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        ahead, behind = (perceptron._gradient(x, y, flat + s * step, layers, classes)[0] for s in (1, -1))
        assert found[1 + i] == pytest.approx((ahead - behind) / 2e-6, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("bank", [REGRESSORS, CLASSIFIERS])
def test_steps_plan_no_queries(spark, monkeypatch, bank):
    """Rows are read for the scales and for the blocks; the steps work on the blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    frame = training_frame(spark, x, x[:, 0] > 0)
    ctx, read = context_of(frame, 2 if bank is CLASSIFIERS else 0, 42, 0.1), []
    for name in ("agg", "mapInPandas", "mapInArrow"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, _plain=plain, _name=name, **k: (read.append(_name), _plain(self, *a, **k))[1])
    model = spec(bank, "mlp_ann").train(frame, ctx)
    assert model.kind in ("mlp_class", "mlp_value") and len(read) <= 4, read


def test_classes_beyond_a_plane_are_learned(spark):
    """Rings around the origin, beside a feature on another scale."""
    rng = np.random.default_rng(7)
    radius, angle = rng.uniform(0, 3, 900), rng.uniform(0, 2 * np.pi, 900)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle), 1e6 + 1e3 * rng.normal(size=900)])
    y = np.floor(radius)
    frame = training_frame(spark, x, y)
    out = spec(CLASSIFIERS, "mlp_ann").train(frame, context_of(frame, 3, 42, 0.25)).transform(frame)
    assert training._score(out, "classification") >= 0.95
    assert max(abs(sum(r["probability"]) - 1) for r in out.select("probability").limit(20).collect()) < 1e-9


def test_equal_rows_are_packed_once(spark, monkeypatch):
    """Rows that are equal travel once a task, with their number; the sums of a step are those of all rows."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 3, 900), rng.integers(0, 4, 900), np.ones(900)]).astype(float)
    y = (x[:, 0] > rng.integers(0, 2, 900)).astype(float)
    frame = training_frame(spark, x, y).repartition(3)
    held = {"all": perceptron.weighted_blocks(frame, F.col("label"), [0.0] * 3, [1.0] * 3)}
    monkeypatch.setattr(perceptron, "HELD_VALUES", 100)
    held["few at a time"] = perceptron.weighted_blocks(frame, F.col("label"), [0.0] * 3, [1.0] * 3)
    layers, flat = [3, 4, 2], rng.normal(size=26)
    plain = perceptron._gradient(x, y, flat, layers, True)
    for name, blocks in held.items():
        blocks = [(a.astype(float), b.astype(float), c) for a, b, c in blocks.collect()]
        assert sum(len(b) if c is None else c.sum() for _, b, c in blocks) == 900
        np.testing.assert_allclose(sum(perceptron._gradient(a, b, flat, layers, True, c) for a, b, c in blocks), plain, rtol=1e-9)
    assert sum(len(b) for _, b, _ in held["all"].collect()) <= 3 * 24
    apart = perceptron.weighted_blocks(training_frame(spark, rng.normal(size=(500, 3)), y[:500]), F.col("label"), [0.0] * 3, [1.0] * 3).collect()
    assert all(w is None for _, _, w in apart) and sum(len(y) for _, y, _ in apart) == 500
