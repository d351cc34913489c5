"""Forests grown without a depth limit."""

import numpy as np
import pytest

from conftest import training_frame
from gleanery.models import forest
from gleanery.models.base import Fitted, context_of
from gleanery.models.trees import fit_extra_trees, fit_forest


def brute_tree(x, y, w, plan, path):
    """The same tree by plain recursion: a dict, or a leaf's value."""
    held = w > 0
    x, y, w = x[held], y[held], w[held]
    k = plan.classes or 1
    stats = np.eye(k)[y.astype(int)] * w[:, None] if plan.classes else (w * y)[:, None]
    value = stats.sum(axis=0) / w.sum()
    varying = x.max(axis=0) > x.min(axis=0)
    if y.max() == y.min() or not varying.any():
        return value
    ranks = forest._ranks(np.array([path], np.uint64), x.shape[1])[0]
    options = []
    for j in sorted(np.flatnonzero(varying), key=lambda j: int(ranks[j]))[:plan.tries]:
        levels = np.unique(x[:, j])
        if plan.random:
            cuts = [float(forest._cut_between(levels[:1], levels[-1:], ranks[j:j + 1])[0])]
        else:
            cuts = [(a + b) / 2 for a, b in zip(levels, levels[1:])]
        for c in cuts:
            score = sum((stats[side].sum(axis=0) ** 2).sum() / w[side].sum() for side in (x[:, j] <= c, x[:, j] > c))
            options.append((score, j, c))
    _, j, c = next(o for o in options if o[0] >= max(options)[0] * (1 - 1e-9))
    sides = [x[:, j] <= c, x[:, j] > c]
    return {"at": (j, c), "sides": [brute_tree(x[s], y[s], w[s], plan, forest.child_path(np.uint64(path), i)) for i, s in enumerate(sides)]}


def same(tree, node, brute):
    if not isinstance(brute, dict):
        return tree["feature"][node] < 0 and np.allclose(tree["value"][node], brute)
    j, c = brute["at"]
    return tree["feature"][node] == j and np.isclose(tree["threshold"][node], c) and same(tree, tree["left"][node], brute["sides"][0]) and same(
        tree, tree["right"][node], brute["sides"][1])


@pytest.mark.parametrize("random", [False, True])
@pytest.mark.parametrize("classes", [0, 3])
def test_trees_equal_plain_recursion(random, classes):
    draw = np.random.default_rng(1)
    x = np.column_stack([draw.normal(size=150), draw.integers(0, 5, 150), np.ones(150), draw.integers(0, 2, 150)]).astype(float)
    y = draw.integers(0, 3, 150).astype(float) if classes else x[:, 0] * 2 + draw.normal(size=150)
    plan = forest.Plan(4, classes, 2, random)
    for t in range(4):
        w = forest.draws(np.arange(150), plan, t)
        path = forest.root_path(plan, t)
        tree = forest.grow(x, y, w, plan, path)
        assert same(tree, 0, brute_tree(x, y, w, plan, path))


def deep(n=60):
    """The best cut always takes off the largest row, so a tree has as many levels as rows."""
    return np.arange(n, dtype=float)[:, None], 3.0 ** np.arange(n)


def test_depth_has_no_limit(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    x, y = deep()
    frame = training_frame(spark, x, y)
    shallow = DecisionTreeRegressor(maxDepth=20, maxBins=256).fit(frame).transform(frame).select("prediction").distinct().count()
    assert shallow <= 21
    model = forest.fit(frame, forest.Plan(3, 0, 1, bootstrap=False), 1, len(x))
    got = model.transform(frame).select("label", "prediction").collect()
    assert all(r["prediction"] == pytest.approx(r["label"], rel=1e-12) for r in got)


@pytest.fixture(scope="module")
def rule(spark):
    draw = np.random.default_rng(2)
    x = np.column_stack([draw.integers(0, 60, 900), draw.integers(0, 40, 900), draw.integers(0, 9, 900)]).astype(float)
    return x, ((x[:, 0] + x[:, 1] > 50) ^ (x[:, 2] > 6)).astype(float)


@pytest.mark.parametrize("kind", ["forest", "extra", "numbers"])
def test_nodes_too_large_for_a_task(spark, rule, kind):
    """Sums by Spark for the top and tasks below give the rows the predictions that one task gives; cuts there lie on values."""
    x, y = rule
    y = y if kind != "numbers" else x[:, 0] * 2 - x[:, 1]
    frame = training_frame(spark, x, y)
    plan = forest.Plan(6, 0 if kind == "numbers" else 2, 2, kind == "extra", kind == "forest")
    large = forest.fit(frame, plan, 3, 900, task_bytes=8 * 6 * 120)
    assert large.tables["trees"].count() == 6
    both = large.transform(frame)
    if kind == "extra":
        assert both.filter("prediction = label").count() == 900
        return
    whole = forest.fit(frame, plan, 3, 900)
    one, two = ({r["row_id"]: r["prediction"] if kind == "numbers" else r["probability"][1] for r in m.transform(frame).collect()} for m in (whole, large))
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


@pytest.mark.parametrize("task_bytes", [forest.TASK_BYTES, 8 * 6 * 200])
def test_same_forest_from_any_files(spark, rule, task_bytes):
    frame = training_frame(spark, *rule)
    plan = forest.Plan(4, 2, 1)
    trees = [sorted(map(repr, forest.fit(frame.repartition(n), plan, 3, 900, task_bytes=task_bytes).tables["trees"].collect())) for n in (2, 9)]
    assert trees[0] == trees[1]


def test_repeated_rows_and_one_class(spark):
    x = np.zeros((300, 2))
    frame = training_frame(spark, x, np.arange(300) % 2)
    for task_bytes in (forest.TASK_BYTES, 8 * 5 * 20):
        got = forest.fit(frame, forest.Plan(2, 2, 1), 2, 300, task_bytes=task_bytes).transform(frame).select("probability").distinct().collect()
        assert len(got) == 1 and got[0][0][0] == pytest.approx(0.5, abs=0.15)
    sure = fit_forest(training_frame(spark, np.random.default_rng(0).normal(size=(40, 2)), np.ones(40)), context_of(frame, 2, 42, 0.05))
    assert sure.transform(frame).filter("prediction = 1").count() == 300


def test_saved_and_loaded(spark, rule, tmp_path):
    frame = training_frame(spark, *rule)
    model = fit_extra_trees(frame, context_of(frame, 2, 42, 0.1))
    model.save(spark, str(tmp_path / "m"))
    back = Fitted.load(spark, str(tmp_path / "m"))
    one, two = ({r["row_id"]: r["probability"] for r in m.transform(frame).collect()} for m in (model, back))
    assert one == two and model.transform(frame).filter("prediction = label").count() > 890


def test_trees_travel_in_bounded_groups(spark, rule, monkeypatch):
    from gleanery.operators import explain

    frame = training_frame(spark, *rule)
    model = fit_forest(frame, context_of(frame, 2, 42, 0.05))
    whole = {r["row_id"]: r["probability"][1] for r in model.transform(frame).collect()}
    monkeypatch.setattr(forest.sent_trees, "__defaults__", (20_000,))
    assert len(list(forest.sent_trees(model))) > 2
    parts = {r["row_id"]: r["probability"][1] for r in model.transform(frame).collect()}
    assert all(whole[k] == pytest.approx(parts[k], abs=1e-12) for k in whole)
    for r in explain.shap_tree(frame.limit(30), model).collect():
        assert r["base"][1] + sum(r["shap"][1]) == pytest.approx(whole[r["row_id"]], abs=1e-9)


def test_pure_nodes_are_leaves_and_groups_of_trees_agree(spark, rule):
    """Nodes with more rows than a task holds end where they are pure; finishing a few trees at a time changes nothing."""
    frame = training_frame(spark, *rule)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    one, two = (forest.fit(frame, forest.Plan(12, 2, 2), 3, 900, task_bytes=8 * 6 * 120, dealt_bytes=b).tables["trees"].orderBy("tree").collect() for b in (1 << 30, 1))
    assert one == two and len(one) == 12
    for tree in one:
        value = np.array(tree["value"]).reshape(-1, 2)
        assert all(value[i].max() < 1 for i, f in enumerate(tree["feature"]) if f >= 0)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    half = training_frame(spark, rule[0][:, :1], (rule[0][:, 0] > 29).astype(float))
    whole = forest.fit(half, forest.Plan(3, 2, 1, bootstrap=False), 1, 900, task_bytes=8 * 4 * 20)
    assert {len(t["feature"]) for t in whole.tables["trees"].collect()} == {3}
    assert whole.transform(half).filter("prediction = label").count() == 900
