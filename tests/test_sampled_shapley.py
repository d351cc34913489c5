"""Shapley values by sampling against plain walks, and tables of leaf values against walked trees."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gleanery.models import forest
from gleanery.operators import explain as ex


def test_walks_score_only_what_changes_and_equal_plain_walks(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (40, 3)).astype(float)
    background = rng.integers(0, 3, (6, 3)).astype(float).tolist()
    df = spark.createDataFrame([(f"r{i}", Vectors.dense(x)) for i, x in enumerate(points)], ["row_id", "features"])
    seen = spark.sparkContext.accumulator(0)
    curved = lambda x: x[0] * x[1] + max(x[1], x[2]) - x[0] * x[2]

    @F.udf("double")
    def output(x):
        seen.add(1)
        return float(curved(x))

    values = ex.shap_sampled(df, lambda d: d.withColumn("y", output(vector_to_array("features"))), "y", ["a", "b", "c"], background, rounds=9, seed=5)
    got = {(r["row"], r["feature"]): r["value"] for r in values.collect()}
    order, want, steps = np.random.default_rng(5), {}, 0
    plans = [([int(i) for i in order.permutation(3)], background[r % 6]) for r in range(9)]
    for i, x in enumerate(points):
        total = np.zeros(3)
        for turns, b in plans:
            here = list(b)
            steps += max(0, sum(x != np.array(b)) - 1)
            for j in turns:
                before, here[j] = curved(here), x[j]
                total[j] += curved(here) - before
        want |= {(f"r{i}", name): v / 9 for name, v in zip("abc", total)}
    assert got == pytest.approx(want, abs=1e-9)
    assert seen.value == steps + len(points) + len(background)


def _tree(rng, cuts, width):
    """A random tree whose left child holds the smaller values."""
    feature, threshold, left, right, todo = [-1], [0.0], [-1], [-1], [0]
    for n in range(cuts):
        node = todo.pop(int(rng.integers(len(todo))))
        feature[node], threshold[node], left[node], right[node] = int(rng.integers(width)), float(rng.normal()), len(feature), len(feature) + 1
        for _ in range(2):
            todo.append(len(feature))
            for part, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
                part.append(v)
    return (*[np.array(part) for part in (feature, threshold, left, right)], rng.normal(size=(len(feature), 2)), np.ones(len(feature)))


def test_tables_of_leaves_equal_walked_trees():
    rng = np.random.default_rng(1)
    trees = [_tree(rng, cuts, 4) for cuts in (0, 3, 8, 20, 2, 400, 5, 1)]
    shared = forest.tabled(trees)
    assert [len(t[0]) for t in shared[2]] == [801] and 0 < len(shared[1]) < 7
    x = rng.normal(size=(500, 4))
    x[:8, 0], x[8:40, 1] = trees[1][1][:7].max(), [np.nan, -np.inf, np.inf, 0.0] * 8
    want = sum(tree[4][forest._land(x, tree)] for tree in trees)
    np.testing.assert_allclose(forest.leaf_sums(x, shared), want, atol=1e-12)
    np.testing.assert_allclose(forest.leaf_sums(x[:0], shared), want[:0])
    forest.WAYS_BYTES, held = 0, forest.WAYS_BYTES
    try:
        np.testing.assert_allclose(forest.leaf_sums(x, forest.tabled(trees)), want, atol=1e-12)
    finally:
        forest.WAYS_BYTES = held
