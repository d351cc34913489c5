"""Second-order boosting against a plain booster."""

import math

import numpy as np
import pytest

from conftest import training_frame
from gleanery.models import boost
from gleanery.models.base import Fitted, context_of
from gleanery.models.trees import fit_catboost_style, fit_lgbm_style, fit_xgb_style
from gleanery.operators import explain


def gain_of(g, h, side, how):
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + how.l2)
    if min(side.sum(), (~side).sum()) < max(how.least_rows, 1) or min(h[side].sum(), h[~side].sum()) < how.least_hessian:
        return -np.inf
    return (worth(side) + worth(~side) - worth(np.ones(len(g), bool))) / 2 - how.least_gain


def options(x, g, h, rows, how):
    """(gain, feature, cut) of every split of some rows; cuts lie on values."""
    return [(gain_of(g[rows], h[rows], x[rows, j] <= c, how), j, c) for j in range(x.shape[1]) for c in np.unique(x[:, j])[:-1]]


def best(found):
    top = max((o[0] for o in found), default=-np.inf)
    return next(o for o in found if o[0] >= top * (1 - 1e-9)) if top > 1e-12 else None


def plain_tree(x, g, h, how):
    """Row groups of the leaves, and the splits made."""
    groups, splits = [np.arange(len(x))], []

    def divide(i, j, c):
        rows = groups[i]
        splits.append((j, c))
        groups[i:i + 1] = [rows[x[rows, j] <= c], rows[x[rows, j] > c]]

    if how.shape == "leaf":
        while len(groups) < how.leaves:
            found = [(b[0], -i, b) for i, rows in enumerate(groups) if (b := best(options(x, g, h, rows, how)))]
            if not found:
                break
            _, i, (_, j, c) = max(found, key=lambda f: f[0])
            divide(-i, j, c)
        return groups, splits
    for _ in range(how.depth):
        if how.shape == "symmetric":
            tables = [[max(o[0], 0.0) for o in options(x, g, h, rows, how)] for rows in groups]
            summed = [(s, j, c) for s, (_, j, c) in zip(np.sum(tables, axis=0), options(x, g, h, groups[0], how))]
            top = best(summed)
            if not top:
                break
            for i in range(len(groups) - 1, -1, -1):
                divide(i, *top[1:])
        else:
            for i in range(len(groups) - 1, -1, -1):
                if top := best(options(x, g, h, groups[i], how)):
                    divide(i, *top[1:])
    return groups, splits


def plain_margins(x, y, classes, how):
    outputs = classes if classes > 2 else 1
    mean = y.mean()
    margin = np.tile([mean] if not classes else [math.log(mean / (1 - mean))] if classes == 2 else [0.0] * outputs, (len(x), 1)).astype(float)
    for _ in range(how.rounds):
        g, h = boost._slopes(margin, y, classes)
        for c in range(outputs):
            for rows in plain_tree(x, g[:, c], h[:, c], how)[0]:
                if len(rows):
                    margin[rows, c] -= g[rows, c].sum() / (h[rows, c].sum() + how.l2) * how.rate
    return margin


SHAPES = {"level": boost.Booster(4, 0.3, "level", depth=3), "leaf": boost.Booster(4, 0.2, "leaf", leaves=7, l2=0.0, least_hessian=1e-3, least_rows=5),
          "symmetric": boost.Booster(4, 0.3, "symmetric", depth=3, l2=3.0, least_hessian=0.0), "gamma": boost.Booster(3, 0.3, "level", depth=4, least_gain=0.5, least_hessian=4.0)}


@pytest.fixture(scope="module")
def small(spark):
    draw = np.random.default_rng(4)
    x = np.column_stack([draw.integers(0, 30, 240), draw.integers(0, 4, 240), draw.integers(0, 20, 240)]).astype(float)
    return x, draw.normal(size=240)


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("shape", list(SHAPES))
def test_margins_equal_a_plain_booster(spark, small, shape, classes):
    x, noise = small
    raw = x[:, 0] / 10 + x[:, 1] * (x[:, 2] > 8) + noise / 2
    y = raw if not classes else np.minimum((raw > 2).astype(float) + (raw > 3.5), classes - 1)
    frame = training_frame(spark, x, y)
    model = boost.fit(frame, SHAPES[shape], classes, 3, len(x))
    values = {r["row_id"]: r for r in explain.shap_tree(frame, model).collect()}
    want = plain_margins(x, y, classes, SHAPES[shape])
    for i in range(len(x)):
        r = values[f"r{i:06d}"]
        assert [b + sum(s) for b, s in zip(r["base"], r["shap"])] == pytest.approx(want[i].tolist(), abs=1e-6)
    got = {r["row_id"]: r for r in model.transform(frame).collect()}
    for i in range(len(x)):
        r = got[f"r{i:06d}"]
        if not classes:
            assert r["prediction"] == pytest.approx(want[i, 0], abs=1e-6)
        else:
            p = 1 / (1 + np.exp(-want[i, 0])) if classes == 2 else np.exp(want[i]) / np.exp(want[i]).sum()
            assert r["probability"][1] == pytest.approx(p if classes == 2 else p[1], abs=1e-6)


def test_same_trees_from_any_files(spark, small):
    x, noise = small
    frame = training_frame(spark, x, x[:, 0] + noise)
    how = boost.Booster(12, 0.3)
    trees = [sorted(map(repr, boost.fit(frame.repartition(n), how, 0, 3, 240).tables["trees"].collect())) for n in (2, 9)]
    assert trees[0] == trees[1]


@pytest.mark.parametrize("fit", [fit_xgb_style, fit_lgbm_style, fit_catboost_style])
def test_styles_learn_a_rule_and_travel(spark, fit, tmp_path):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1500, 4))
    frame = training_frame(spark, x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float))
    model = fit(frame, context_of(frame, 2, 42, 0.3))
    model.save(spark, str(tmp_path / "m"))
    assert Fitted.load(spark, str(tmp_path / "m")).transform(frame).filter("prediction = label").count() > 1350
    top = explain.native_importance(model, list("abcd"), spark).collect()
    assert {r["feature"] for r in top[:2]} == {"a", "b"}


def test_nothing_to_split(spark):
    frame = training_frame(spark, np.ones((50, 2)), np.arange(50) % 2)
    for how in SHAPES.values():
        got = boost.fit(frame, how, 2, 2, 50).transform(frame).select("probability").distinct().collect()
        assert len(got) == 1 and got[0][0][1] == pytest.approx(0.5)


def test_a_pass_lands_rows_in_the_growing_tree_only():
    """Margins of finished trees come with the rows; a pass over them needs no older tree."""
    draw = np.random.default_rng(4)
    bins, y, margin = draw.integers(0, 4, (50, 2)).astype(np.uint8), draw.normal(size=50), draw.normal(size=(50, 1))
    growing = [(np.array([0, -1, -1]), np.array([1, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]))]
    got = boost._sums([(bins, y, margin)], growing, [np.array([2])], 0, 2, 4, 2.0**30)
    right = bins[:, 0] > 1
    for j in range(2):
        for b in range(4):
            own = right & (bins[:, j] == b)
            assert got[0, j, b, 2] == own.sum() and got[0, j, b, 0] / 2.0**30 == pytest.approx((margin[own, 0] - y[own]).sum(), abs=1e-6)


@pytest.mark.parametrize("shape", ["leaf", "symmetric"])
@pytest.mark.parametrize("classes", [0, 3])
def test_rows_that_share_bins_and_label_are_one(spark, monkeypatch, shape, classes):
    """They travel once with their number, and one task or many make the same trees of them as of rows that are all packed."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 5, 600), rng.integers(0, 6, 600), rng.integers(0, 2, 600)]).astype(float)
    y = (x[:, 0] + rng.integers(0, 2, 600)) % 3
    frame = training_frame(spark, x, y).repartition(4)
    cuts = [np.unique(c)[:-1] for c in x.T]
    packed = boost._blocks(frame.select(boost.vector_to_array("features").alias("x"), boost.F.col("label").alias("y")), cuts, 3, 3).collect()
    rows = [(tuple(b), v, n) for r in packed for b, v, n in zip(np.frombuffer(r["bins"], np.uint8).reshape(-1, 3).tolist(), np.frombuffer(r["y"]), np.frombuffer(r["n"]))]
    assert len(rows) == len({r[:2] for r in rows}) < 400 and sum(r[2] for r in rows) == 600
    trees = [sorted(map(repr, boost.fit(frame, SHAPES[shape], classes, 3, 600).tables["trees"].collect()))]
    monkeypatch.setattr(boost, "LOCAL_ROWS", 0)
    trees.append(sorted(map(repr, boost.fit(frame, SHAPES[shape], classes, 3, 600).tables["trees"].collect())))
    monkeypatch.setattr(boost, "merged_chunks", lambda chunks, room: ((a, b, np.ones(len(b))) for a, b in chunks))
    trees.append(sorted(map(repr, boost.fit(frame, SHAPES[shape], classes, 3, 600).tables["trees"].collect())))
    assert trees[0] == trees[1] == trees[2]
