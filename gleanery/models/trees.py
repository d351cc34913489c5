"""Trees, forests and boosting."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from . import boost, forest, stumps
from .base import RESERVED, Context, Fitted, fit_one_vs_rest, fit_spark, predictor


def fit_tree(df: DataFrame, ctx: Context, depth: int = 12) -> Fitted:
    kind = DecisionTreeClassifier if ctx.classes else DecisionTreeRegressor
    return fit_spark(kind(maxDepth=depth, maxBins=256, seed=ctx.seed), df)


def _tries(ctx: Context) -> int:
    """Features looked at in a node: the square root of their number for classes, all for numbers."""
    return max(1, math.isqrt(ctx.width)) if ctx.classes else max(1, ctx.width)


def fit_forest(df: DataFrame, ctx: Context, trees: int = 200) -> Fitted:
    """Bootstrap draws of rows, best cuts, trees grown until their leaves are pure."""
    return forest.fit(df, forest.Plan(ctx.scaled(trees, 5), ctx.classes, _tries(ctx), seed=ctx.seed), ctx.width, ctx.n)


def fit_boosted(df: DataFrame, ctx: Context, trees: int = 100, depth: int = 3, rate: float = 0.1) -> Fitted:
    """Gradient boosted trees; several classes are boosted one against the rest, with normalised probabilities."""
    options = dict(maxIter=ctx.scaled(trees, 3), maxDepth=depth, stepSize=rate, maxBins=64, seed=ctx.seed, checkpointInterval=10)
    if not ctx.classes:
        return fit_spark(GBTRegressor(**options), df)
    if ctx.classes <= 2:
        return fit_spark(GBTClassifier(**options), df)
    return fit_one_vs_rest(lambda: GBTClassifier(**options), df, ctx.classes, True)


def fit_extra_trees(df: DataFrame, ctx: Context, trees: int = 200) -> Fitted:
    """All rows in every tree; each node draws one cut for each feature it looks at and takes the best of them."""
    return forest.fit(df, forest.Plan(ctx.scaled(trees, 2), ctx.classes, _tries(ctx), True, False, ctx.seed), ctx.width, ctx.n)


def _second_order(df: DataFrame, ctx: Context, how: boost.Booster) -> Fitted:
    return boost.fit(df, replace(how, rounds=ctx.scaled(how.rounds, 3)), ctx.classes, ctx.width, ctx.n)


def fit_xgb_style(df: DataFrame, ctx: Context) -> Fitted:
    """Trees by level, shrunken leaves, a least Hessian per child."""
    return _second_order(df, ctx, boost.Booster(100, 0.3, "level", depth=6, l2=1.0, least_hessian=1.0))


def fit_lgbm_style(df: DataFrame, ctx: Context) -> Fitted:
    """Trees by best leaf, at least 20 rows in each of up to 31."""
    return _second_order(df, ctx, boost.Booster(200, 0.1, "leaf", leaves=31, l2=0.0, least_hessian=1e-3, least_rows=20))


def fit_catboost_style(df: DataFrame, ctx: Context) -> Fitted:
    """Symmetric trees: one split for all nodes of a level. Boosting is plain, not ordered."""
    return _second_order(df, ctx, boost.Booster(200, 0.05, "symmetric", depth=6, l2=3.0, least_hessian=0.0))


# ---------------------------------------------------------------- adaptive boosting

def fit_ada_classifier(df: DataFrame, ctx: Context, rounds: int = 50) -> Fitted:
    """SAMME: stumps on reweighted rows."""
    return stumps.fit(df, ctx, ctx.scaled(rounds, 3))


def fit_ada_regressor(df: DataFrame, ctx: Context, rounds: int = 50, depth: int = 3) -> Fitted:
    """AdaBoost.R2 with linear loss; rows are weighted rather than resampled."""
    rows = df.select("features", "label").withColumn("_w", F.lit(1.0))
    parts, votes = [], []
    for r in range(ctx.scaled(rounds, 3)):
        tree = DecisionTreeRegressor(maxDepth=depth, weightCol="_w", maxBins=64, seed=ctx.seed + r).fit(rows)
        scored = tree.transform(rows).withColumn("_err", F.abs(F.col("label") - F.col("prediction")))
        s = scored.agg(F.max("_err").alias("worst"), F.sum(F.col("_w") * F.col("_err")).alias("bad"), F.sum("_w").alias("all")).first()
        loss = (s["bad"] / s["all"]) / s["worst"] if s["worst"] else 0.0
        if loss >= 0.5 and parts:
            break
        beta = max(loss, 1e-10) / (1.0 - min(loss, 1 - 1e-10))
        parts.append(tree)
        votes.append(max(math.log(1.0 / beta), 1e-10))
        if loss <= 0 or loss >= 0.5:
            break
        shrink = F.pow(F.lit(beta), 1.0 - F.col("_err") / F.lit(s["worst"]))
        rows = scored.select("features", "label", (F.col("_w") * shrink * (1.0 / float(s["all"]))).alias("_w"))
        if r % 10 == 9:
            rows = cut(rows)
    return Fitted("ada_median", parts, {"votes": votes})


@predictor("ada_median")
def _ada_median(model: Fitted, df: DataFrame) -> DataFrame:
    """The value at which half of the votes is reached when the trees' values are put in order."""
    out = df
    for i, part in enumerate(model.parts):
        out = part.transform(out).withColumn(f"_p{i}", F.col("prediction")).drop(*RESERVED)
    votes = model.params["votes"]
    pairs = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(v)).alias("v")) for i, v in enumerate(votes)]))
    half = sum(votes) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(acc, pair):
        total = acc["sum"] + pair["v"]
        return F.struct(total.alias("sum"), F.when(acc["at"].isNull() & (total >= half), pair["p"]).otherwise(acc["at"]).alias("at"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["at"])
    return out.withColumn("prediction", found).drop(*[f"_p{i}" for i in range(len(votes))])
