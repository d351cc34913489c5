"""K-means runs trained side by side."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from gleanery.models import cluster as cl
from gleanery.models.kmeans import best_of, fit_runs


def frame(spark, x, parts=5):
    return spark.createDataFrame([(f"r{i}", [float(v) for v in row]) for i, row in enumerate(x)], "row_id string, x array<double>").repartition(parts)


def cost_of(x, centres):
    return ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()


def test_starts_share_their_passes(spark):
    df = frame(spark, np.random.default_rng(0).random((400, 2))).cache()
    df.count()
    context = spark.sparkContext
    context.setJobGroup("starts", "twenty starts")
    out = cl.fit_kmeans(df, 6, 20)
    jobs = len(context.statusTracker().getJobIdsForGroup("starts"))
    context.setJobGroup("rest", "")
    assert out.select("cluster").distinct().count() == 6
    assert jobs < 100  # a start alone takes ten or more


def test_runs_are_lloyd_optima_as_cheap_as_sparks(spark):
    x = np.random.default_rng(1).normal(size=(900, 3)) + 1e4
    df = frame(spark, x)
    runs = fit_runs(df, [(k, 42 + s) for k in (2, 5) for s in range(6)])
    for k, run in best_of(runs).items():
        place = ((x[:, None] - run.centres) ** 2).sum(axis=2).argmin(axis=1)
        assert run.cost == pytest.approx(cost_of(x, run.centres)) == pytest.approx(min(r.cost for r in runs if r.k == k))
        assert run.weights.tolist() == np.bincount(place, minlength=k).tolist()
        assert np.abs(np.stack([x[place == j].mean(axis=0) for j in range(k)]) - run.centres).max() < 2e-3
        theirs = KMeans(k=k, seed=42, maxIter=300).fit(df.select(array_to_vector("x").alias("features"))).summary.trainingCost
        assert run.cost <= 1.02 * theirs
    again = best_of(fit_runs(frame(spark, x, 2), [(k, 42 + s) for k in (2, 5) for s in range(6)]))
    assert all(np.allclose(again[k].centres, run.centres) for k, run in best_of(runs).items())


def test_weights_and_few_distinct_rows(spark):
    points = spark.createDataFrame([([0.0], 3.0), ([1.0], 1.0), ([10.0], 2.0)], "x array<double>, w double")
    run, = fit_runs(points, [(2, 1)], "x", "w")
    assert sorted(zip(run.centres[:, 0].tolist(), run.weights.tolist())) == [(0.25, 4.0), (10.0, 2.0)] and run.cost == pytest.approx(0.75)
    run, = fit_runs(points, [(7, 1)], "x", "w")
    assert sorted(run.centres[:, 0].tolist()) == [0.0, 1.0, 10.0]
    with pytest.raises(ValueError):
        fit_runs(points.filter("w > 5"), [(2, 1)], "x", "w")
