"""Gaussian mixtures on planted groups."""

import numpy as np
import pandas as pd

from gleanery.models import cluster as cl


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"row_id": [str(i) for i in range(len(x))], "x": x.tolist()}), "row_id string, x array<double>").repartition(4)


def test_long_groups_that_lie_side_by_side(spark):
    """Groups longer than the gap between them, which k-means cuts in part; their covariances tell them apart."""
    draw = np.random.default_rng(0)
    group = np.arange(900) % 3
    x = np.column_stack([draw.normal(size=900) * 2, draw.normal(size=900) * 0.3 + group * 4])
    got = cl.fit_gaussian_mixture(frame(spark, x), 3).toPandas()
    owner = {}
    for i, c in zip(got["row_id"].astype(int), got["cluster"]):
        owner.setdefault(c, []).append(group[i])
    assert len(owner) == 3 and sum(max(np.bincount(g)) for g in owner.values()) > 880


def test_groups_far_apart_and_equal_rows(spark):
    x = np.array([[0.0, 0.0]] * 40 + [[10.0, 0.0]] * 40 + [[0.0, 10.0]] * 40)
    got = cl.fit_gaussian_mixture(frame(spark, x), 3).toPandas()
    assert got.groupby(got["row_id"].astype(int) // 40)["cluster"].nunique().tolist() == [1, 1, 1] and got["cluster"].nunique() == 3
    assert cl.fit_gaussian_mixture(frame(spark, x[:0].reshape(0, 2))).count() == 0
