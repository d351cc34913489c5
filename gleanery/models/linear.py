"""Linear models. Losses that Spark ML lacks are solved as short sequences of weighted least squares fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from .base import Context, Fitted, fit_spark, predictor
from .perceptron import ROWS, lbfgs, row_blocks

NORMAL_LIMIT = 4096


def _solver(ctx: Context) -> str:
    return "normal" if ctx.width <= NORMAL_LIMIT else "l-bfgs"


def fit_logistic(df: DataFrame, ctx: Context, c: float = 1.0, max_iter: int = 2000) -> Fitted:
    """L2 logistic regression; strength C means a penalty of 1 / (C n) per row."""
    return fit_spark(LogisticRegression(regParam=1.0 / (c * ctx.n), standardization=False, maxIter=ctx.scaled(max_iter, 20), tol=1e-5), df)


def fit_least_squares(df: DataFrame, ctx: Context, l2: float = 0.0, l1: float = 0.0, max_iter: int = 5000) -> Fitted:
    """Minimise RSS / (2n) + l1 |w| + l2 |w|^2 / 2 on unscaled features.

    Spark divides both penalties by the deviation of the label, which is right for the absolute part only, so
    the quadratic part is multiplied by it here (the normal solver uses the population deviation, the other
    one the sample deviation).
    """
    quadratic = l2 * ctx.label_std * (1.0 if l1 == 0 else (ctx.n / max(1, ctx.n - 1)) ** 0.5)
    strength = l1 + quadratic
    est = LinearRegression(regParam=strength, elasticNetParam=l1 / strength if strength else 0.0, standardization=False,
                           solver=_solver(ctx) if l1 == 0 else "l-bfgs", maxIter=ctx.scaled(max_iter, 50), tol=1e-9)
    return fit_spark(est, df)


def _weighted_ridge(df: DataFrame, target: Column, weight: Column, penalty: float, ctx: Context):
    """argmin sum w (t - f)^2 + penalty |coef|^2 with a free intercept."""
    ready = df.select("features", target.alias("_t"), weight.alias("_w")).filter(F.col("_w") > 0)
    s = ready.agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_t")).alias("wt"),
                  F.sum(F.col("_w") * F.col("_t") * F.col("_t")).alias("wtt")).first()
    if not s["w"]:
        return None
    std = max((s["wtt"] / s["w"] - (s["wt"] / s["w"]) ** 2), 0.0) ** 0.5
    if std == 0.0:
        return None
    est = LinearRegression(featuresCol="features", labelCol="_t", weightCol="_w", predictionCol="_f", standardization=False,
                           regParam=penalty / s["w"] * std, solver=_solver(ctx))
    return est.fit(ready)


def _l2_svm(df: DataFrame, ctx: Context, positive: float, c: float, rounds: int):
    """Squared hinge loss by Newton steps: each is a ridge fit to the rows inside the margin."""
    sign = F.when(F.col("label") == positive, 1.0).otherwise(-1.0)
    base = df.select("features", sign.alias("_y"))
    best, best_value, model = None, float("inf"), _weighted_ridge(base, F.col("_y"), F.lit(1.0), 0.5 / c, ctx)
    for _ in range(rounds):
        if model is None:
            break
        scored = model.transform(base)
        gap = F.greatest(1.0 - F.col("_y") * F.col("_f"), F.lit(0.0))
        loss = scored.agg(F.sum(gap * gap).alias("v")).first()["v"]
        value = 0.5 * float(np.square(model.coefficients.toArray()).sum()) + c * loss
        if value >= best_value - 1e-6 * abs(best_value):
            break
        best, best_value = model, value
        inside = scored.select("features", "_y", (F.col("_y") * F.col("_f") < 1.0).cast("double").alias("_in"))
        model = _weighted_ridge(inside, F.col("_y"), F.col("_in"), 0.5 / c, ctx)
    return best or model


def fit_linear_svc(df: DataFrame, ctx: Context, c: float = 1.0, rounds: int = 12) -> Fitted:
    """Squared-hinge support vector classifier; one hyperplane per class beyond two."""
    rounds = ctx.scaled(rounds, 3)
    targets = [1.0] if ctx.classes <= 2 else [float(i) for i in range(ctx.classes)]
    planes = [_l2_svm(df, ctx, t, c, rounds) for t in targets]
    return Fitted("planes", [], {
        "has_probability": False, "classes": ctx.classes,
        "planes": [[*([0.0] * ctx.width if p is None else p.coefficients.toArray().tolist()), -1.0 if p is None else float(p.intercept)] for p in planes]})


@predictor("planes")
def _planes(model: Fitted, df: DataFrame) -> DataFrame:
    x = vector_to_array("features")

    def side(plane):
        weights = F.array(*[F.lit(float(v)) for v in plane[:-1]])
        return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(plane[-1])), lambda s, v: s + v)

    scores = [side(p) for p in model.params["planes"]]
    if len(scores) == 1:
        return df.withColumn("margin", scores[0]).withColumn("prediction", (F.col("margin") > 0).cast("double"))
    out = df.withColumn("_scores", F.array(*scores))
    return out.withColumn("prediction", (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double")).drop("_scores")


# ---------------------------------------------------------------- absolute and epsilon-insensitive loss

def _insensitive(df: DataFrame, ctx: Context, epsilon: float, c: float, rounds: int):
    """Support vector regression by reweighting.

    max(0, |r| - e) is the mean of |r - e| and |r + e|, less e. Each absolute value lies below a parabola that
    touches it at the current residual, so every round is one ridge fit with weights and shifted targets.
    """
    base = df.select("features", "label")
    model = _weighted_ridge(base, F.col("label"), F.lit(1.0), 0.5 / c, ctx)
    floor = 1e-4 * ctx.label_std
    for _ in range(rounds):
        if model is None:
            break
        scored = model.transform(base)
        r = F.col("label") - F.col("_f")
        above, below = 0.25 / F.greatest(F.abs(r - epsilon), F.lit(floor)), 0.25 / F.greatest(F.abs(r + epsilon), F.lit(floor))
        shifted = F.col("label") - epsilon * (above - below) / (above + below)
        step = scored.select("features", shifted.alias("_target"), (above + below).alias("_weight"))
        model = _weighted_ridge(step, F.col("_target"), F.col("_weight"), 0.5 / c, ctx)
    return model


def fit_linear_svr(df: DataFrame, ctx: Context, epsilon: float = 0.0, c: float = 1.0, rounds: int = 15) -> Fitted:
    model = _insensitive(df, ctx, epsilon, c, ctx.scaled(rounds, 4))
    if model is None:
        value = df.agg(F.avg("label").alias("m")).first()["m"]
        return Fitted("plane_value", [], {"plane": [*[0.0] * ctx.width, float(value)]})
    return Fitted("plane_value", [], {"plane": [*model.coefficients.toArray().tolist(), float(model.intercept)]})


@predictor("plane_value")
def _plane_value(model: Fitted, df: DataFrame) -> DataFrame:
    plane = model.params["plane"]
    weights = F.array(*[F.lit(float(v)) for v in plane[:-1]])
    value = F.aggregate(F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b), F.lit(float(plane[-1])), lambda s, v: s + v)
    return df.withColumn("prediction", value)


# ---------------------------------------------------------------- rbf kernel by random features

def random_map(width: int, size: int, gamma: float, seed: int, kind: type = np.float64):
    """A map whose inner products approximate exp(-gamma |a - b|^2) (Rahimi and Recht 2007), in the precision of ``kind``."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, size)).astype(kind), rng.uniform(0.0, 2.0 * np.pi, size).astype(kind)
    scale = kind(np.sqrt(2.0 / size))

    def lift(x: np.ndarray) -> np.ndarray:
        z = x @ w
        z += b
        np.cos(z, out=z)
        z *= scale
        return z

    return lift


def random_features(width: int, size: int, gamma: float, seed: int):
    mapped = random_map(width, size, gamma, seed)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(mapped(np.stack(x.to_numpy()))))

    return lift


def with_random_features(df: DataFrame, params: dict) -> DataFrame:
    lift = random_features(params["width"], params["size"], params["gamma"], params["seed"])
    return df.withColumn("_x", F.col("features")).withColumn("features", array_to_vector(lift(vector_to_array("_x"))))


def _kernel(ctx: Context, size: int) -> dict:
    return {"width": ctx.width, "size": max(16, ctx.scaled(size)), "gamma": 1.0 / (max(1, ctx.width) * ctx.feature_variance), "seed": ctx.seed}


def fit_svm_rbf(df: DataFrame, ctx: Context, c: float = 1.0, size: int = 256) -> Fitted:
    """Hinge loss over random features, by L-BFGS; one hyperplane per class beyond two.

    Rows stay packed as they are and are lifted inside the pass, so a step is one short job that moves one plane per task.
    """
    kernel = _kernel(ctx, size)
    width, size = kernel["width"], kernel["size"]
    blocks = row_blocks(df, F.col("label"), [0.0] * width, [1.0] * width)
    lift = random_map(width, size, kernel["gamma"], kernel["seed"], np.float32)

    def loss_of(positive: float) -> Callable:
        def ask(plane: np.ndarray) -> tuple[float, np.ndarray]:
            def part(rows):
                total = np.zeros(size + 2)
                for x, y in rows:
                    z, sign = lift(x), np.where(y == positive, 1.0, -1.0)
                    gap = 1.0 - sign * (z @ plane[:-1].astype(np.float32) + plane[-1])
                    pull = np.where(gap > 0, -sign, 0.0)
                    total += np.concatenate([[np.maximum(gap, 0.0).sum()], pull.astype(np.float32) @ z, [pull.sum()]])
                yield total

            sums = blocks.mapPartitions(part)
            total = sums.treeReduce(np.add) if blocks.getNumPartitions() > 64 else sums.reduce(np.add)
            inner = np.append(plane[:-1], 0.0)
            return float(0.5 * inner @ inner / (c * ctx.n) + total[0] / ctx.n), inner / (c * ctx.n) + total[1:] / ctx.n

        return ask

    targets = [1.0] if ctx.classes <= 2 else [float(i) for i in range(ctx.classes)]
    try:
        planes = [lbfgs(loss_of(t), np.zeros(size + 1), ctx.scaled(100, 20)).tolist() for t in targets]
    finally:
        blocks.unpersist()
    return Fitted("lifted", [], {"has_probability": False, "kernel": kernel, "inner": "planes", "inner_params": {"classes": ctx.classes, "planes": planes}})


def _insensitive_lifted(df: DataFrame, ctx: Context, kernel: dict, epsilon: float, c: float, rounds: int) -> list[float]:
    """The rounds of ``_insensitive`` over random features; coefficients and intercept.

    Rows stay packed as they are and are lifted inside the pass, so a round is one job that sums weighted products of the lifted rows.
    """
    width, size, floor = kernel["width"], kernel["size"], 1e-4 * ctx.label_std
    blocks = row_blocks(df, F.col("label"), [0.0] * width, [1.0] * width, np.float64)
    lift = random_map(width, size, kernel["gamma"], kernel["seed"])

    def ridge(plane: np.ndarray | None) -> np.ndarray:
        def part(rows):
            total = np.zeros((size + 2, size + 2))
            for x, y in rows:
                z, target, weight = lift(x), y, np.ones(len(y))
                if plane is not None:
                    r = y - z @ plane[:-1] - plane[-1]
                    above, below = 0.25 / np.maximum(np.abs(r - epsilon), floor), 0.25 / np.maximum(np.abs(r + epsilon), floor)
                    target, weight = y - epsilon * (above - below) / (above + below), above + below
                all_ = np.column_stack([z, target, np.ones(len(y))])
                total += all_.T @ (all_ * weight[:, None])
            yield total

        sums = blocks.mapPartitions(part)
        total = sums.treeReduce(np.add) if blocks.getNumPartitions() > 64 else sums.reduce(np.add)
        mean = total[:-1, -1] / total[-1, -1]
        inner = total[:-1, :-1] - np.outer(mean, total[:-1, -1])
        coefficients = np.linalg.solve(inner[:-1, :-1] + 0.5 / c * np.eye(size), inner[:-1, -1])
        return np.append(coefficients, mean[-1] - mean[:-1] @ coefficients)

    try:
        plane = ridge(None)
        for _ in range(rounds):
            plane = ridge(plane)
    finally:
        blocks.unpersist()
    return plane.tolist()


def fit_svr_rbf(df: DataFrame, ctx: Context, c: float = 1.0, epsilon: float = 0.1, size: int = 256) -> Fitted:
    kernel = _kernel(ctx, size)
    plane = _insensitive_lifted(df, ctx, kernel, epsilon, c, ctx.scaled(15, 4))
    return Fitted("lifted", [], {"kernel": kernel, "inner": "plane_value", "inner_params": {"plane": plane}})


def _lifted_scores(df: DataFrame, kernel: dict, planes: list[list[float]]) -> Column:
    """The value of every plane, per row; rows are lifted and weighed in one step."""
    lift, weights = random_map(kernel["width"], kernel["size"], kernel["gamma"], kernel["seed"]), np.array(planes).T

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.stack(x.to_numpy())
        return pd.Series([v for i in range(0, len(rows), ROWS) for v in lift(rows[i:i + ROWS]) @ weights[:-1] + weights[-1]])

    return score(vector_to_array("features"))


@predictor("lifted")
def _lifted(model: Fitted, df: DataFrame) -> DataFrame:
    inner, params = model.params["inner"], model.params["inner_params"]
    if inner in ("planes", "plane_value"):
        planes = params.get("planes") or [params["plane"]]
        out = df.withColumn("_scores", _lifted_scores(df, model.params["kernel"], planes))
        if inner == "plane_value":
            return out.withColumn("prediction", F.col("_scores")[0]).drop("_scores")
        if len(planes) == 1:
            out = out.withColumn("margin", F.col("_scores")[0])
            return out.withColumn("prediction", (F.col("margin") > 0).cast("double")).drop("_scores")
        return out.withColumn("prediction", (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double")).drop("_scores")
    # Classifiers saved before the hinge loss was solved here.
    out = Fitted(inner, model.parts, params).transform(with_random_features(df, model.params["kernel"]))
    return out.drop("features").withColumnRenamed("_x", "features")
