"""Comparing models: folds, scores, leaderboard, and the choice among task kinds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import joined_text
from ..functions.types import quoted
from ..models.bank import TEXT_CLASSIFIERS, TEXT_REGRESSORS, TEXT_SEQUENCE, Spec, bank_for
from ..models.base import Context, context_of
from ..models import cluster as clusters
from ..models import series as ts
from ..operators.features import label_classes, label_encode
from ..operators.split import fold_count, kfold_assign, stratified_folds, train_test_split
from ..session import keep, spread

BOARD_SCHEMA = "model string, family string, cv_mean_score double, cv_std double, test_score double, has_probability boolean, status string, error string"
MIN_TEXT_ROWS, MIN_APPEND_ROWS, MIN_IMAGES = 16, 30, 20


@dataclass
class TrainingResult:
    leaderboard: DataFrame
    best_name: str | None
    best: object | None
    test: DataFrame | None = None
    classes: list[str] | None = None
    models: dict = field(default_factory=dict)
    kind: str = "tabular"
    failed: dict[str, str] = field(default_factory=dict)


def assemble(df: DataFrame, feature_columns: list[str], label, row_id: str) -> DataFrame:
    """(row_id, features, label) for training."""
    ready = spread(df).select(quoted(row_id).cast("string").alias("row_id"), label.cast("double").alias("label"), *[quoted(c).cast("double").alias(f"f{i}") for i, c in enumerate(feature_columns)])
    out = VectorAssembler(inputCols=[f"f{i}" for i in range(len(feature_columns))], outputCol="features", handleInvalid="error").transform(ready)
    return out.select("row_id", "features", "label")


def _score(predicted: DataFrame, problem_type: str) -> float:
    if problem_type == "classification":
        return predicted.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("v")).first()["v"] or 0.0
    row = predicted.agg(F.sum(F.pow(F.col("label") - F.col("prediction"), 2)).alias("sse"),
                        (F.var_pop("label") * F.count("label")).alias("sst")).first()
    return 1.0 - row["sse"] / row["sst"] if row["sst"] else 0.0


def _one(spec: Spec, train: DataFrame, test: DataFrame, ctx: Context, problem_type: str, folds: int):
    """Cross-validated and held-out score of one model; a failure is recorded, not hidden."""
    try:
        scores = []
        for f in range(folds):
            part = train.filter(F.col("fold") != f)
            model = spec.train(part, Context(**{**ctx.__dict__, "n": max(1, ctx.n * (folds - 1) // folds)}))
            scores.append(_score(model.transform(train.filter(F.col("fold") == f)), problem_type))
        model = spec.train(train, ctx)
        held_out = _score(model.transform(test), problem_type)
        cv = (round(float(np.mean(scores)), 4), round(float(np.std(scores)), 4)) if scores else (round(held_out, 4), 0.0)
        return (spec.name, spec.family, *cv, round(float(held_out), 4), spec.has_probability, "ok", None), model
    except Exception as problem:  # noqa: BLE001 - any estimator may fail on odd data
        return (spec.name, spec.family, None, None, None, spec.has_probability, "failed", str(problem)[:500]), None


def evaluate_bank(bank: list[Spec], train: DataFrame, test: DataFrame, problem_type: str, classes: int = 0,
                  folds: int | None = None, budget: float = 1.0, parallel: int = 4, seed: int = 42):
    """Leaderboard rows and trained models. Training rows carry their fold; models train side by side."""
    folds = fold_count(len(bank)) if folds is None else folds
    if folds:
        marked = stratified_folds(train, "label", ["row_id"], folds) if problem_type == "classification" else train.withColumn("fold", kfold_assign(["row_id"], folds))
    else:
        marked = train
    marked, test = keep(marked), keep(test)
    has_vector = "features" in marked.columns
    if has_vector:
        ctx = context_of(marked, classes, seed, budget)
    else:
        row = marked.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("std")).first()
        ctx = Context(row["n"], 0, classes, float(row["std"] or 1.0), 1.0, seed, budget)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        found = list(pool.map(lambda s: _one(s, marked, test, ctx, problem_type, folds), bank))
    marked.unpersist()
    rows = [r for r, _ in found]
    models = {r[0]: m for r, m in found if m is not None}
    return rows, models


def leaderboard_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return rank_supervised(spark.createDataFrame(rows, BOARD_SCHEMA))


def rank_supervised(board: DataFrame) -> DataFrame:
    return board.orderBy(F.col("test_score").desc_nulls_last(), F.col("model"))


def leaderboard_proba_only(board: DataFrame) -> DataFrame:
    """With a business template only models that give probabilities stand, if there are any."""
    trained = F.col("has_probability") & (F.col("status") == "ok") if "status" in board.columns else F.col("has_probability")
    any_proba = board.agg(F.coalesce(F.bool_or(trained), F.lit(False)).alias("_any"))
    return board.join(F.broadcast(any_proba)).filter(F.col("has_probability") | ~F.col("_any")).drop("_any")


def leaderboard_union(board: DataFrame, more: DataFrame) -> DataFrame:
    return rank_supervised(board.unionByName(more, allowMissingColumns=True))


def train_tabular(features: DataFrame, feature_columns: list[str], target: str, problem_type: str, row_id: str,
                  use_case_id: str | None = None, bank: list[Spec] | None = None, budget: float = 1.0, folds: int | None = None,
                  select_by: str = "test", seed: int = 42) -> TrainingResult:
    spark = features.sparkSession
    known = features.filter(quoted(target).isNotNull())
    classes = None
    label = quoted(target).cast("double")
    if problem_type == "classification":
        classes = label_classes(known, target)
        label = label_encode(target, classes)
    data = keep(assemble(known, feature_columns, label, row_id))
    train, test = train_test_split(data, ["row_id"], seed)
    rows, models = evaluate_bank(bank or bank_for(problem_type), train, test, problem_type, len(classes or []), folds, budget, seed=seed)
    eligible = [r for r in rows if r[6] == "ok"]
    if use_case_id and problem_type == "classification":
        eligible = [r for r in eligible if r[5]] or eligible
    place = 4 if select_by == "test" else 2
    best = min(eligible, key=lambda r: (-r[place], r[0]))[0] if eligible else None
    board = leaderboard_frame(spark, rows)
    if use_case_id and problem_type == "classification":
        board = rank_supervised(leaderboard_proba_only(board))
    return TrainingResult(board, best, models.get(best), test, classes, models)


def train_text(df: DataFrame, text_columns: list[str], target: str, row_id: str, budget: float = 1.0, folds: int = 3,
               bank: list[Spec] | None = None, seed: int = 42, problem_type: str = "classification") -> TrainingResult | None:
    """Classical and sequence text models on the joined text; too few rows give none. Regressions have sequence models only."""
    classify = problem_type == "classification"
    complete = df.dropna(subset=[*text_columns, target])
    if complete.limit(MIN_TEXT_ROWS).count() < MIN_TEXT_ROWS:
        return None
    classes = label_classes(complete, target) if classify else None
    label = label_encode(target, classes) if classify else quoted(target).cast("double")
    data = keep(spread(complete).select(quoted(row_id).cast("string").alias("row_id"), joined_text(text_columns).alias("text"),
                                label.alias("label")))
    train, test = train_test_split(data, ["row_id"], seed)
    if classify:
        classical, sequence = bank or TEXT_CLASSIFIERS, [] if bank else TEXT_SEQUENCE
    else:
        classical, sequence = [], bank or TEXT_REGRESSORS
    n = len(classes or [])
    rows, models = evaluate_bank(classical, train, test, problem_type, n, folds, budget, seed=seed) if classical else ([], {})
    more, extra = evaluate_bank(sequence, train, test, problem_type, n, 0, budget, parallel=2, seed=seed) if sequence else ([], {})
    models.update(extra)
    board = leaderboard_union(leaderboard_frame(df.sparkSession, rows), leaderboard_frame(df.sparkSession, more)) if more else leaderboard_frame(df.sparkSession, rows)
    done = [r for r in [*rows, *more] if r[6] == "ok"]
    best = min(done, key=lambda r: (-r[4], r[0]))[0] if done else None
    return TrainingResult(board, best, models.get(best), test, classes, models, "text")


def train_clusters(df: DataFrame, columns: list[str], row_id: str, starts: int = 10, seed: int = 42,
                   ks: list[int] | None = None, methods: list[str] | None = None) -> TrainingResult:
    """K-means over a range of k and the other methods, ranked by silhouette; assignments are kept for explaining."""
    spark = df.sparkSession
    data = keep(df.select(quoted(row_id).cast("string").alias("row_id"), F.array(*[quoted(c).cast("double") for c in columns]).alias("x")))
    n, width = data.count(), len(columns)
    sweep = list(ks or clusters.sweep_range(n))
    others = {
        "agglomerative": lambda: clusters.fit_agglomerative(data, 3, seed=seed),
        "gaussian_mixture": lambda: clusters.fit_gaussian_mixture(data, 3, seed),
        "birch": lambda: clusters.fit_birch(data, width, 3, 0.5, seed=seed),
        "dbscan": lambda: clusters.fit_dbscan(data, width, 0.8, 5),
    }
    runs = {m: f for m, f in others.items() if methods is None or m in methods}

    def run(item):
        name, make = item
        try:
            assigned = keep(make())
            row = clusters.judge(assigned, name, not name.startswith("kmeans")).first()
            return (tuple(row) if row else None), assigned, None
        except Exception as problem:  # noqa: BLE001 - a method may not suit the data; the result names it
            return None, None, str(problem)[:500]

    with ThreadPoolExecutor(max_workers=3) as pool:
        swept = pool.submit(clusters.fit_sweep, data, sweep, starts, seed)
        runs |= {f"kmeans_k{k}": (lambda k=k: swept.result()[k]) for k in sweep}
        found = dict(zip(runs, pool.map(run, runs.items())))
    schema = "model string, family string, silhouette_score double, n_labels bigint, noise_share double, from_bank boolean, metric string"
    board = clusters.select_clusterings(spark.createDataFrame([r for r, _, _ in found.values() if r], schema))
    top = board.first()
    return TrainingResult(board, top["model"] if top else None, found[top["model"]][1] if top else None, None, None,
                          {k: a for k, (_, a, _) in found.items() if a is not None}, "clustering",
                          {k: why for k, (_, _, why) in found.items() if why})


def train_series(df: DataFrame, order: str, value: str, series: str | None = None) -> TrainingResult:
    forecasts = keep(ts.arima_forecasts(df, order, value, series))
    board = ts.rank_models(ts.arima_leaderboard(forecasts), ["series"], "test_mae", True)
    top = board.orderBy("rank", "series").first()
    if top is None:
        raise RuntimeError("All time series models failed to fit")
    return TrainingResult(board, top["model"], forecasts, kind="time_series")


def choose_task(problem_type: str, n_text_columns: int, n_complete_text: int, n_images: int, both: bool = False) -> list[str]:
    """Which trainers run, in order.

    Images win over text and text over tables for a classification; a table with text also gets the sequence
    models on its board from 30 complete rows on. ``both`` runs the tabular bank next to the text bank.
    """
    if problem_type in ("clustering", "time_series"):
        return [problem_type]
    if problem_type == "classification" and n_images >= MIN_IMAGES:
        return ["image"]
    text = problem_type == "classification" and n_text_columns > 0 and n_complete_text >= MIN_TEXT_ROWS
    if text and not both:
        return ["text"]
    more = n_text_columns > 0 and n_complete_text >= MIN_APPEND_ROWS
    return ["tabular", *(["text"] if text else []), *(["sequence"] if more and not text else [])]


def task_column(problem_type, n_text_columns, n_complete_text, n_images):
    """The same choice for a table of data sets, as text."""
    classify = problem_type == "classification"
    return (F.when(problem_type.isin("clustering", "time_series"), problem_type)
            .when(classify & (n_images >= MIN_IMAGES), "image")
            .when(classify & (n_text_columns > 0) & (n_complete_text >= MIN_TEXT_ROWS), "text")
            .when((n_text_columns > 0) & (n_complete_text >= MIN_APPEND_ROWS), "tabular+sequence")
            .otherwise("tabular"))
