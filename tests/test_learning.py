"""Models on planted data, saving and loading, explanations, clusters, series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import training_frame
from gleanery.models import cluster as cl
from gleanery.models import series as ts
from gleanery.models.bank import CLASSIFIERS, REGRESSORS, TEXT_CLASSIFIERS, TEXT_SEQUENCE, model_family, spec
from gleanery.models.base import Context, Fitted, context_of
from gleanery.models.linear import fit_least_squares, fit_linear_svc, fit_linear_svr
from gleanery.models.texts import TextModel
from gleanery.operators import explain as ex
from gleanery.operators.evaluate import silhouette, silhouette_rows
from gleanery.operators.features import class_values
from gleanery.operators.iforest import detect_anomalies
from gleanery.plans import training
from gleanery.session import fresh_path


def blobs(k, n=300, seed=0, gap=6.0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [gap, gap, 0], [-gap, gap, gap]])[:k]
    y = np.arange(n) % k
    return centres[y] + rng.normal(size=(n, 3)), y


def noisy_line(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, 3 * x[:, 0] - 2 * x[:, 1] + 5 + rng.normal(0, 0.1, n)


@pytest.fixture(scope="module")
def two(spark):
    return training_frame(spark, *blobs(2)).cache()


@pytest.fixture(scope="module")
def three(spark):
    return training_frame(spark, *blobs(3)).cache()


@pytest.fixture(scope="module")
def line(spark):
    return training_frame(spark, *noisy_line()).cache()


@pytest.mark.parametrize("name", [s.name for s in CLASSIFIERS])
@pytest.mark.parametrize("classes", [2, 3])
def test_classifiers_separate_blobs(two, three, name, classes):
    frame = two if classes == 2 else three
    s = spec(CLASSIFIERS, name)
    out = s.train(frame, context_of(frame, classes, 42, 0.1)).transform(frame)
    assert out.count() == 300
    assert training._score(out, "classification") >= 0.95
    if s.has_probability:
        p = out.select("probability", "prediction").toPandas()
        assert all(len(v) == classes and abs(sum(v) - 1) < 1e-6 for v in p["probability"])
    else:
        assert "probability" not in out.columns


STRAIGHT = {"linear_regression", "ridge", "linear_svr", "elastic_net"}


@pytest.mark.parametrize("name", [s.name for s in REGRESSORS])
def test_regressors_follow_the_line(line, name):
    s = spec(REGRESSORS, name)
    out = s.train(line, context_of(line, 0, 42, 0.25)).transform(line)
    assert training._score(out, "regression") >= {"lasso": 0.75, "elastic_net": 0.75, "extra_trees": 0.8, "catboost": 0.85, "mlp_ann": 0.85, "svr_rbf": 0.85}.get(name, 0.9)


def test_penalties_match_closed_form(spark):
    x, y = noisy_line()
    y = y * 17
    frame = training_frame(spark, x, y)
    xc, yc, n = x - x.mean(0), y - y.mean(), len(x)
    got = fit_least_squares(frame, context_of(frame), l2=30.0 / n).parts[0].coefficients.toArray()
    assert got == pytest.approx(np.linalg.solve(xc.T @ xc + 30.0 * np.eye(3), xc.T @ yc), rel=1e-6)
    got = fit_least_squares(frame, context_of(frame), l1=4.0, l2=0.3).parts[0].coefficients.toArray()
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - 4.0, 0) / (xc[:, j] @ xc[:, j] / n + 0.3)
    assert got == pytest.approx(w, rel=1e-4, abs=1e-4)


def test_support_vectors_minimise_their_loss(spark):
    x, y = blobs(2, 200, 4, 1.5)
    frame = training_frame(spark, x, y)
    sign = np.where(y == 1, 1.0, -1.0)
    plane = np.array(fit_linear_svc(frame, context_of(frame, 2)).params["planes"][0])
    loss = lambda p: 0.5 * (p[:3] ** 2).sum() + (np.maximum(0, 1 - sign * (x @ p[:3] + p[3])) ** 2).sum()
    rng = np.random.default_rng(0)
    assert all(loss(plane) <= loss(plane + rng.normal(0, s, 4)) + 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_absolute_loss_shrugs_off_outliers(spark):
    x, y = noisy_line()
    y[:40] += 1000
    frame = training_frame(spark, x, y)
    plane = fit_linear_svr(frame, context_of(frame), rounds=40).params["plane"]
    assert plane == pytest.approx([3, -2, 0, 5], abs=0.15)


@pytest.mark.parametrize("name", ["logistic_regression", "linear_svc", "svm_rbf", "knn", "extra_trees", "ada_boost", "mlp_ann", "xgboost"])
def test_saved_model_predicts_the_same(spark, three, name):
    model = spec(CLASSIFIERS, name).train(three, context_of(three, 3, 42, 0.05))
    path = fresh_path(spark, "model")
    model.save(spark, path)
    again = Fitted.load(spark, path)
    a, b = model.transform(three).select("row_id", "prediction"), again.transform(three).select("row_id", "prediction")
    assert a.exceptAll(b).count() == 0


def test_result_does_not_depend_on_partitioning(line):
    for name in ("linear_svr", "mlp_ann", "decision_tree"):
        s, ctx = spec(REGRESSORS, name), context_of(line, 0, 42, 0.05)
        one = s.train(line, ctx).transform(line).select("row_id", F.round("prediction", 4).alias("p"))
        two = s.train(line.repartition(11), ctx).transform(line).select("row_id", F.round("prediction", 4).alias("p"))
        gap = one.join(two.withColumnRenamed("p", "q"), "row_id").agg(F.max(F.abs(F.col("p") - F.col("q"))).alias("g")).first()["g"]
        assert gap < 1e-2, name


def test_leaderboard_records_failures(spark, two):
    broken = training.Spec("broken", lambda d, c: (_ for _ in ()).throw(ValueError("no")))
    rows, models = training.evaluate_bank([spec(CLASSIFIERS, "logistic_regression"), broken], two, two, "classification", 2, 2, 0.05)
    board = training.leaderboard_frame(spark, rows).collect()
    assert [r["status"] for r in board] == ["ok", "failed"] and board[1]["error"] == "no" and "broken" not in models
    assert model_family("knn") == "instance_based" and model_family("?") == "other"


def test_route():
    route = training.choose_task
    assert route("clustering", 1, 100, 100) == ["clustering"] and route("time_series", 0, 0, 0) == ["time_series"]
    assert route("classification", 1, 16, 20) == ["image"] and route("classification", 1, 16, 19) == ["text"]
    assert route("classification", 1, 15, 0) == ["tabular"] and route("regression", 1, 30, 0) == ["tabular", "sequence"]
    assert route("classification", 1, 40, 0, both=True) == ["tabular", "text"]


# ---------------------------------------------------------------- text

@pytest.fixture(scope="module")
def sentences(spark):
    rng = np.random.default_rng(2)
    topics = [["ship", "sea", "sail", "wave", "harbour"], ["bread", "oven", "flour", "dough", "crust"], ["goal", "ball", "team", "pitch", "score"]]
    rows = [(f"d{i}", " ".join(rng.choice(topics[i % 3], 12)) + " the and of", float(i % 3)) for i in range(150)]
    return spark.createDataFrame(rows, "row_id string, text string, label double").cache()


@pytest.mark.parametrize("name", [s.name for s in TEXT_CLASSIFIERS + TEXT_SEQUENCE])
def test_text_models(spark, sentences, name):
    s = spec(TEXT_CLASSIFIERS + TEXT_SEQUENCE, name)
    model = s.train(sentences, Context(150, 0, 3, 1.0, 1.0, 42, 0.2))
    out = model.transform(sentences)
    assert training._score(out, "classification") >= 0.9
    path = fresh_path(spark, "text-model")
    model.save(spark, path)
    again = TextModel.load(spark, path).transform(sentences)
    assert out.select("row_id", "prediction").exceptAll(again.select("row_id", "prediction")).count() == 0


# ---------------------------------------------------------------- explanation

def _hand_shapley(f, x, background):
    """All subsets, for a handful of features."""
    from itertools import combinations
    from math import factorial

    p, out = len(x), np.zeros(len(x))
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for size in range(p):
            for s in combinations(rest, size):
                weight = factorial(size) * factorial(p - size - 1) / factorial(p)
                out[i] += weight * (f(set(s) | {i}) - f(set(s)))
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classes"])
def test_tree_values_add_up(spark, line, three, kind):
    name, bank, frame, k = {"tree": ("decision_tree", REGRESSORS, line, 0), "forest": ("random_forest", REGRESSORS, line, 0),
                            "boosted": ("gradient_boosting", REGRESSORS, line, 0), "classes": ("random_forest", CLASSIFIERS, three, 3)}[kind]
    model = spec(bank, name).train(frame, context_of(frame, k, 42, 0.1))
    out = ex.shap_tree(frame, model).join(model.transform(frame).withColumn("row_id", F.col("row_id")), "row_id").toPandas()
    for _, r in out.iterrows():
        for c in range(len(r["base"])):
            want = r["probability"][c] if k else r["prediction"]
            assert r["base"][c] + sum(r["shap"][c]) == pytest.approx(want, abs=1e-6)


def test_tree_values_equal_all_subsets(spark, line):
    model = spec(REGRESSORS, "decision_tree").train(line, context_of(line, 0, 42, 0.1))
    leaves = ex.tree_leaves(next(ex.packed_trees(model, spark))[0])
    rows = ex.shap_tree(line.limit(5), model).join(line.select("row_id", vector_to_array("features").alias("x")), "row_id").collect()
    for r in rows:
        def value(known):
            total = 0.0
            for leaf in leaves:
                weight = 1.0
                for f, share in leaf["shares"].items():
                    steps = [(t, up) for g, t, up in leaf["steps"] if g == f]
                    weight *= (float(all((r["x"][f] > t) == up for t, up in steps)) if f in known else share)
                total += weight * leaf["value"][0]
            return total
        assert r["shap"][0] == pytest.approx(_hand_shapley(value, r["x"], None), abs=1e-9)


def test_sampled_values_add_up(spark, line):
    model = spec(REGRESSORS, "linear_regression").train(line, context_of(line))
    background = [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    values = ex.shap_sampled(line, model.transform, "prediction", ["a", "b", "c"], background, rounds=4).groupBy("row").agg(F.sum("value").alias("s"))
    base = training_frame(spark, np.array(background), np.zeros(2))
    mean = model.transform(base).agg(F.avg("prediction").alias("m")).first()["m"]
    both = model.transform(line).join(values, F.col("row") == F.col("row_id"))
    assert both.filter(F.abs(F.col("prediction") - mean - F.col("s")) > 1e-6).count() == 0 and both.count() == 400


def test_permuting_noise_changes_nothing(line):
    model = spec(REGRESSORS, "linear_regression").train(line, context_of(line))
    got = {r["feature"]: r for r in ex.permutation_importance(line, model.transform, "regression", ["a", "b", "noise"]).collect()}
    assert got["a"]["importance"] > got["b"]["importance"] > 0.3 and abs(got["noise"]["importance"]) < 0.01
    assert got["a"]["std"] > 0


def test_saliency_and_native(spark, line):
    model = spec(REGRESSORS, "random_forest").train(line, context_of(line, 0, 42, 0.1))
    top = ex.native_importance(model, ["a", "b", "noise"], spark).collect()
    assert top[0]["feature"] == "a" and sum(r["importance"] for r in top) == pytest.approx(1)


# ---------------------------------------------------------------- anomalies

def test_planted_outliers_are_flagged(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    x[:30] += 15
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(k=[f"r{i}" for i in range(3000)]))
    out = detect_anomalies(df, trees=40).toPandas()
    flagged = out[out.is_anomaly == 1]["k"].str[1:].astype(int)
    assert len(flagged) == pytest.approx(60, abs=3) and set(range(30)) <= set(flagged)


def test_copies_count_as_rows_when_sampling(spark):
    """A third of all rows are copies of one row: that spot is normal, lone far rows are not."""
    rng = np.random.default_rng(1)
    x = np.vstack([np.full((3000, 2), 4.0), rng.normal(size=(6000, 2)), rng.normal(size=(20, 2)) + 30])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("ab")).assign(i=range(len(x)))).withColumn("i", F.col("i").cast("string"))
    out = detect_anomalies(df, contamination=0.01, trees=12, sample=64, with_score=True).toPandas()
    out["i"] = out["i"].astype(int)
    assert out[out.i < 3000]["is_anomaly"].sum() == 0 and 0 < out["is_anomaly"].sum() <= 91
    assert out[out.i >= 9000]["anomaly_score"].min() > out[out.i < 3000]["anomaly_score"].max()


def test_flags_do_not_depend_on_files(spark, tmp_path):
    """The same rows in two and in nine files, one row owning a third of them beyond a run of copies."""
    rng = np.random.default_rng(2)
    x = np.vstack([np.full((5000, 2), 4.0), rng.normal(size=(9000, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("ab")).assign(k=[f"r{i}" for i in range(len(x))]))
    flags = []
    for files in (2, 9):
        df.repartition(files).write.parquet(f"{tmp_path}/{files}")
        out = detect_anomalies(spark.read.parquet(f"{tmp_path}/{files}"), trees=20)
        flags.append({r["k"] for r in out.filter("is_anomaly = 1").select("k").collect()})
    assert flags[0] == flags[1] and 0 < len(flags[0]) <= 280


def test_no_numbers_no_anomalies(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert detect_anomalies(df).agg(F.sum("is_anomaly")).first()[0] == 0


# ---------------------------------------------------------------- clusters

def points(spark, x):
    return spark.createDataFrame([(f"r{i}", [float(v) for v in row]) for i, row in enumerate(x)], "row_id string, x array<double>").repartition(5)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_every_method_finds_three_blobs(spark):
    x, y = blobs(3, 300, 3, 12.0)
    df = points(spark, x)
    for name, out in {"kmeans": cl.fit_kmeans(df, 3, 3), "ward": cl.fit_agglomerative(df, 3), "ward of summaries": cl.fit_agglomerative(df, 3, summaries=40),
                      "mixture": cl.fit_gaussian_mixture(df, 3), "birch": cl.fit_birch(df, 3, 3), "birch of summaries": cl.fit_birch(df, 3, 3, summaries=30)}.items():
        got = out.toPandas()
        truth = y[got["row_id"].str[1:].astype(int)]
        assert same_partition(got["cluster"], truth), name


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= least
    label = np.full(len(x), -1)
    current = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = current
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(d[j] & core & (label < 0)):
                    label[k] = current
                    todo.append(k)
            current += 1
    return core, label, d


@pytest.mark.parametrize("shape", ["moons", "hot", "wide"])
def test_dbscan_against_brute_force(spark, shape):
    rng = np.random.default_rng(7)
    t = rng.uniform(0, np.pi, 200)
    if shape == "moons":
        x = np.vstack([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.4 - np.sin(t)]]) + rng.normal(0, 0.04, (400, 2))
        x = np.vstack([x, rng.uniform(-2, 3, (20, 2))])
        eps = 0.15
    elif shape == "hot":
        x = np.vstack([np.full((150, 2), 0.25), rng.normal(0, 0.02, (150, 2)), rng.uniform(-1, 1, (150, 2))])
        eps = 0.1
    else:
        x = np.vstack([rng.normal(0, 0.3, (60, 5)), rng.normal(2, 0.3, (60, 5)), rng.uniform(-2, 4, (30, 5))])
        eps = 0.8
    core, label, near = brute_dbscan(x, eps, 5)
    df = points(spark, x)
    found = {tuple(r["x"]): r["is_core"] for r in cl.core_points(df, x.shape[1], eps, 5).collect()}
    assert all(found[tuple(float(v) for v in row)] == c for row, c in zip(x, core))
    got = cl.fit_dbscan(df, x.shape[1], eps, 5).toPandas()
    mine = dict(zip(got["row_id"].str[1:].astype(int), got["cluster"]))
    mine = np.array([mine[i] for i in range(len(x))])
    assert same_partition(mine[core], label[core])
    for i in np.flatnonzero(~core):
        reachable = set(mine[np.flatnonzero(near[i] & core)])
        assert mine[i] in reachable if reachable else mine[i] == -1


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)] + [("hub", f"leaf{i}") for i in range(300)]
    df = spark.createDataFrame(edges, "a string, b string")
    got = cl.connected_components(df).groupBy("root").count().collect()
    assert sorted((r["root"], r["count"]) for r in got) == [("hub", 301), ("n0000", 301)]


def test_silhouette_both_ways(spark):
    x, y = blobs(3, 90, 5, 8.0)
    df = spark.createDataFrame([(row.tolist(), int(c)) for row, c in zip(x, y)], "x array<double>, cluster long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(90):
        a = d[i][(y == y[i])].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i][y == c].mean() for c in range(3) if c != y[i])
        s.append((b - a) / max(a, b))
    exact = silhouette(df, "x", "cluster", metric="euclidean").first()
    assert exact["metric"] == "euclidean" and exact["silhouette"] == round(np.mean(s), 4)
    assert silhouette_rows(df, "x", "cluster", 90, block=20).agg({"silhouette": "avg"}).first()[0] == pytest.approx(np.mean(s))
    squared = silhouette(df, "x", "cluster").first()
    assert squared["metric"] == "squared_euclidean" and squared["silhouette"] > 0.8


def test_many_classes_are_all_found_or_refused(spark):
    df = spark.range(120).selectExpr("concat('c', id % 60) AS y")
    assert len(class_values(df, "y")) == 60
    with pytest.raises(ValueError):
        class_values(df, "y", 59)


def test_selection_rules(spark):
    board = spark.createDataFrame([("a", "clustering", 0.3, 3, 0.0, False, "m"), ("b", "clustering", 0.9, 1, 0.0, False, "m"),
                                   ("c", "clustering", 0.8, 4, 0.6, True, "m"), ("d", "clustering", 0.5, 2, 0.5, True, "m")],
                                  "model string, family string, silhouette_score double, n_labels long, noise_share double, from_bank boolean, metric string")
    assert [r["model"] for r in cl.select_clusterings(board).collect()] == ["d", "a"]
    assert list(cl.sweep_range(60)) == list(range(2, 10)) and list(cl.sweep_range(10)) == [2]


# ---------------------------------------------------------------- series

def make_series(n, phi, seed):
    rng = np.random.default_rng(seed)
    w, y = 0.0, [100.0]
    for _ in range(n - 1):
        w = phi * w + rng.normal()
        y.append(y[-1] + w)
    return y


def series_frame(spark, data):
    rows = [(k, i, float(v)) for k, ys in data.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "s string, t long, y double").withColumn("t", F.timestamp_seconds(F.col("t") * 3600)).repartition(6)


def test_forecasts_and_stretches(spark):
    df = series_frame(spark, {"a": make_series(900, 0.6, 1), "b": make_series(500, -0.4, 2)})
    prepared = ts.prepare(df, "t", "y", "s")
    assert prepared.filter("is_train").groupBy("series").count().orderBy("series").collect() == [("a", 720), ("b", 400)]
    out = ts.fit_forecast(prepared, (1, 1, 1))
    short = ts.with_lags(prepared.select("series", "position", "y"), "y", 3, "l", stretch=50)
    whole = ts.with_lags(prepared.select("series", "position", "y"), "y", 3, "l")
    assert short.exceptAll(whole).count() == 0 and short.count() == 1400
    board = ts.arima_leaderboard(out).collect()
    assert len(board) == 2 and all(r["test_mae"] < 60 for r in board)


@pytest.mark.parametrize("order", ts.ORDERS)
def test_far_steps_equal_the_recursion(order):
    p, _, q = order
    phi, theta = [0.5, -0.2][:p], [0.3, 0.1][:q]
    changes, shocks = [1.0, -0.5][:p], [0.7, 0.4][:q]
    path = ts._Path(10.0, phi, theta, changes, shocks)
    w, level = changes[::-1], 10.0
    for h in range(1, 30):
        nxt = sum(phi[i] * w[-1 - i] for i in range(p)) + sum(theta[j - 1] * shocks[j - h] for j in range(h, q + 1))
        w.append(nxt)
        level += nxt
        assert path.level(h) == pytest.approx(level)


def test_cluster_query_runs_the_whole_job(monkeypatch):
    """The registered query hands the library no smaller choice of cluster numbers or methods."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from gleanery.catalog import learning

    asked = {}
    monkeypatch.setattr(learning, "run_analysis", lambda *_, **options: asked.update(options) or SimpleNamespace(leaderboard=None))
    monkeypatch.setattr(learning, "table", MagicMock())
    learning.analyze_clusters(None, None)
    assert asked["source"] == "parts" and "cluster_options" not in asked


def test_ngram_vectors_keep_the_first_by_spelling(spark):
    """Equal counts are cut by spelling, weights follow document frequency, and a missing text counts as one without words."""
    import math

    from gleanery.operators.text import NgramVectors

    texts = [" ".join(f"w{i:02d}" for i in range(30))] * 2 + ["w00 w00 zz", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    front = NgramVectors(10).fit(df, "text")
    assert front.counter.vocabulary == ["w00", *[g for i in range(30) for g in (f"w{i:02d}", f"w{i:02d} w{i + 1:02d}") if g != "w00"][:9]]
    assert front.idf[:2] == pytest.approx([math.log(5 / 4) + 1, math.log(5 / 3) + 1])
    got = front.transform(df.filter("text = 'w00 w00 zz'"), "text").first()["features"]
    assert got.indices.tolist() == [0] and got.values.tolist() == pytest.approx([1.0])
