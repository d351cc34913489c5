"""Why a model says what it says: importances, Shapley values, cluster profiles, word saliency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.hashing import row_token
from ..functions.types import quoted, to_long
from ..models import forest
from ..models.base import Fitted
from ..session import cut, fresh_path, spread
from .position import with_position


def top_features(df: DataFrame, importance: str = "importance", n: int = 10) -> DataFrame:
    return df.orderBy(F.col(importance).desc(), F.col("feature")).limit(n)


# ---------------------------------------------------------------- Shapley values

def shap_linear(df: DataFrame, coefficients: dict[str, float], means: dict[str, float] | None = None) -> DataFrame:
    """Exact values of a linear model for all rows: coefficient times distance from the mean, as column expressions."""
    names = list(coefficients)
    if means is None:
        row = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(names)}
    return df.select(*df.columns, *[
        (F.lit(float(coefficients[c])) * (quoted(c).cast("double") - F.lit(float(means[c])))).alias(f"shap_{c}") for c in names])


def shap_importance(df: DataFrame, names: list[str], prefix: str = "shap_", n: int = 10) -> DataFrame:
    """Mean absolute value per feature over all rows, the largest first."""
    row = df.agg(*[F.avg(F.abs(quoted(prefix + c))).alias(f"importance__{i}") for i, c in enumerate(names)])
    return top_features(to_long(row, names, {"importance": "double"}).withColumnRenamed("column", "feature"), n=n)


def shap_aggregate(values: DataFrame, n: int = 10) -> DataFrame:
    """From long values (row, class, feature, value): absolute, averaged over classes, then over rows, top ``n``."""
    per_row = values.groupBy("row", "feature").agg(F.avg(F.abs(F.col("value"))).alias("v"))
    return top_features(per_row.groupBy("feature").agg(F.avg("v").alias("importance")), n=n)


def packed_trees(model, spark):
    """The trees of a model in groups of bounded size, each as (feature, threshold, left, right, value, size) by node.

    Grown forests are read from their table group by group; the node table of a Spark tree model is as large as the model.
    Classification leaves carry class shares, and a tree's share of the sum is in its values.
    """
    if isinstance(model, Fitted):
        if model.kind == "spark":
            yield from packed_trees(model.parts[0], spark)
            return
        scale = 1.0 if model.kind == "boosted" else 1.0 / model.params["trees"]
        for group in forest.sent_trees(model):
            yield [(*tree[:4], tree[4] * scale, tree[5]) for tree in group]
        return
    path = fresh_path(spark, "tree")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = nodes.select("treeID", "nodeData.*") if "nodeData" in nodes.columns else nodes.withColumn("treeID", F.lit(0))
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(getattr(model, "treeWeights", [1.0] * len(by_tree)))
    averaged = hasattr(model, "treeWeights") and "RandomForest" in type(model).__name__
    classes = getattr(model, "numClasses", 0) if "Classif" in type(model).__name__ and "GBT" not in type(model).__name__ else 0
    trees = []
    for t, table in sorted(by_tree.items()):
        scale = 1.0 / len(by_tree) if averaged else weights[t] if t < len(weights) else 1.0
        place = {i: n for n, i in enumerate(sorted(table))}
        rows = [table[i] for i in sorted(table)]
        stats = [np.array(r["impurityStats"], dtype=float) for r in rows]
        sizes = np.array([float(r["rawCount"]) if "rawCount" in r and r["rawCount"] else float(s.sum() if classes else s[0]) for r, s in zip(rows, stats)])
        inner = [r["leftChild"] >= 0 for r in rows]
        trees.append((np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(rows, inner)]),
                      np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(rows, inner)]),
                      np.array([place[r["leftChild"]] if i else -1 for r, i in zip(rows, inner)]), np.array([place[r["rightChild"]] if i else -1 for r, i in zip(rows, inner)]),
                      np.array([s / s.sum() if classes else [float(r["prediction"])] for r, s in zip(rows, stats)]) * scale, sizes))
    yield trees


def tree_leaves(tree) -> list[dict]:
    """The leaves of a packed tree: value, the steps to it, and by feature the share of rows that take those steps."""
    feature, threshold, left, right, value, size = tree
    leaves, todo = [], [(0, [], {})]
    while todo:
        i, steps, shares = todo.pop()
        f = int(feature[i])
        if f < 0:
            leaves.append({"value": value[i], "steps": steps, "shares": shares})
            continue
        for child, upper in ((left[i], False), (right[i], True)):
            todo.append((child, [*steps, (f, float(threshold[i]), upper)], {**shares, f: shares.get(f, 1.0) * (size[child] / size[i] if size[i] else 0.0)}))
    return leaves


class LeafTable:
    """The leaves of a tree as arrays: per leaf the features on its way, each with the open interval of values and its share."""

    def __init__(self, tree, width: int):
        leaves = tree_leaves(tree)
        depth = max(1, max(len(leaf["shares"]) for leaf in leaves))
        shape = (len(leaves), depth)
        self.feature, self.low, self.high, self.share = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
        self.used = np.zeros(shape, bool)
        self.value = np.array([leaf["value"] for leaf in leaves])
        for i, leaf in enumerate(leaves):
            slot = {f: s for s, f in enumerate(leaf["shares"])}
            for f, s in slot.items():
                self.feature[i, s], self.share[i, s], self.used[i, s] = f, leaf["shares"][f], True
            for f, threshold, upper in leaf["steps"]:
                bound = self.low if upper else self.high
                bound[i, slot[f]] = max(bound[i, slot[f]], threshold) if upper else min(bound[i, slot[f]], threshold)
        self.base = (self.value * np.prod(self.share, axis=1)[:, None]).sum(axis=0)
        points, weights = np.polynomial.legendre.leggauss(max(1, (depth + 1) // 2))
        self.points, self.weights, self.width = (points + 1) / 2, weights / 2, width

    def add(self, x: np.ndarray, out: np.ndarray, rows: int = 64, leaves: int = 512) -> None:
        """Add the Shapley values of all rows to ``out`` (row, output, feature).

        With o the indicator that a row follows a leaf's steps on a feature and z the share of rows that do, the value of a feature
        is (o - z) times the integral over t in [0, 1] of the product over the other features of o t + z (1 - t). The
        product is a polynomial, so Gauss-Legendre points give it exactly. A factor is zero only where a row does not follow a step
        that no training row took; the leaf adds nothing to that row then.
        """
        for l in range(0, len(self.value), leaves):
            part = slice(l, l + leaves)
            feature, share, used = self.feature[part], self.share[part], self.used[part]
            hot = np.zeros((*feature.shape, self.width))
            np.put_along_axis(hot, feature[:, :, None], used[:, :, None].astype(float), axis=2)
            for r in range(0, len(x), rows):
                here = x[r:r + rows]
                v = here[:, feature]
                follows = (v > self.low[part]) & (v <= self.high[part])
                for t, weight in zip(self.points, self.weights):
                    yes, no = share * (1 - t) + t, share * (1 - t)
                    product = np.prod(np.where(follows, yes, no), axis=2)
                    rise, fall = (1 - share) / yes, np.full(share.shape, -1 / (1 - t))
                    for c in range(self.value.shape[1]):
                        worth = product * (weight * self.value[part, c])
                        total = worth @ (fall[:, :, None] * hot).sum(axis=1)
                        for s in range(feature.shape[1]):
                            total += (worth * follows[:, :, s]) @ ((rise - fall)[:, s, None] * hot[:, s])
                        out[r:r + rows, c] += total


def shap_tree(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Exact Shapley values of a tree model for all rows: (row_id, base, shap array per output and feature).

    Regression models and boosted ones of two classes have one output, others one per class; boosted outputs are margins. Trees go along in groups of bounded size; each group
    adds its part to every row where the row is, and nothing shuffles.
    """
    width = model.params["width"] if isinstance(model, Fitted) and model.kind != "spark" else (model.parts[0] if isinstance(model, Fitted) else model).numFeatures
    rows = spread(df.select(F.col("row_id").cast("string").alias("row_id"), vector_to_array(features).alias("_x")))
    sums, base = [], np.array(model.params["base"]) if isinstance(model, Fitted) and model.kind == "boosted" else 0.0
    for i, group in enumerate(packed_trees(model, df.sparkSession)):
        tables = [LeafTable(tree, width) for tree in group]
        base, outputs = base + sum(t.base for t in tables), tables[0].value.shape[1]
        shared = df.sparkSession.sparkContext.broadcast(group)

        @F.pandas_udf("array<array<double>>")
        def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tables = [LeafTable(tree, width) for tree in shared.value]
            for xs in batches:
                x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, width))
                out = np.zeros((len(x), outputs, width))
                for t in tables:
                    t.add(x, out)
                yield pd.Series([row.tolist() for row in out], dtype=object)

        rows = rows.withColumn(f"_s{i}", values("_x"))
        sums.append(F.col(f"_s{i}"))
    total = sums[0]
    for more in sums[1:]:
        total = F.zip_with(total, more, lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    return rows.select("row_id", F.array(*[F.lit(float(b)) for b in base]).alias("base"), total.alias("shap"))


def shap_long(values: DataFrame, names: list[str]) -> DataFrame:
    """(row, class, feature, value) from the arrays of ``shap_tree``."""
    table = F.array(*[F.lit(n) for n in names])
    per_class = values.select(F.col("row_id").alias("row"), F.posexplode("shap").alias("class", "v"))
    return per_class.select("row", "class", F.posexplode("v").alias("i", "value")).select("row", "class", F.get(table, F.col("i")).alias("feature"), "value")


def shap_sampled(df: DataFrame, transform, output: str, names: list[str], background: list[list[float]], rounds: int = 10, seed: int = 42) -> DataFrame:
    """Model-agnostic values by permutation sampling (Strumbelj and Kononenko 2014): (row, feature, value).

    Every row is paired with ``rounds`` background rows and orders of the features. Walking an order switches
    one feature at a time from the background to the row, and the change of the output goes to that feature. All
    hybrids are scored by one ``transform``; values add up to the row's output less the mean background output.

    A feature that is alike in both rows changes nothing and gets nothing, so a walk has a step for each of the others. Its first
    hybrid is the background row and its last the row itself, which are scored once each. A value is a weighted sum of a row's outputs;
    they are added up where they are scored.
    """
    rng = np.random.default_rng(seed)
    p, spark = len(names), df.sparkSession
    plans = [(r, [int(i) for i in rng.permutation(p)], background[r % len(background)]) for r in range(rounds)]
    known = spark.createDataFrame([(f"background|{i}", i, Vectors.dense(b)) for i, b in enumerate(background)], ["row_id", "i", "features"])
    start = {r["i"]: float(r["y"]) for r in transform(known).select("i", F.col(output).alias("y")).collect()}
    orders, met = np.array([order for _, order, _ in plans]), np.array([b for _, _, b in plans], float)
    begin = np.array([start[r % len(background)] for r, _, _ in plans])
    rows = df.select(F.col("row_id").alias("row"), vector_to_array("features").alias("x"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("round", "step")],
                           *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mixed", "worth", "less")]])
    walked = rows.mapInArrow(lambda batches: _walks(batches, orders, met, begin), schema)
    hybrids = walked.select("row", F.concat_ws("|", F.col("row").cast("string"), "round", "step").alias("row_id"), array_to_vector("mixed").alias("features"), "worth", "less")
    scored = transform(hybrids).select("row", "worth", "less", F.col(output).alias("y"))
    sums = scored.groupBy("row").agg(*[(F.sum(F.col("worth")[j] * F.col("y")) - F.sum(F.col("less")[j])).alias(f"v{j}") for j in range(p)])
    return sums.select("row", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(f"v{j}") / rounds).alias("value")) for j, n in enumerate(names)])))


def _walks(batches: Iterator[pa.RecordBatch], orders: np.ndarray, met: np.ndarray, begin: np.ndarray, values: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The hybrids of each row: those between the steps of a walk, with what their output is worth to each feature (the step
    just taken gains, the next one loses), and the row itself, which ends every walk, with what the features lose to the backgrounds."""
    rounds, p = orders.shape
    place, many = np.argsort(orders, axis=1), max(1, values // (rounds * p * p))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * p, x.ravel())

    def batch(row, r, s, mixed, worth, less):
        return pa.record_batch([row, pa.array(r, pa.int32()), pa.array(s, pa.int32()), lists(mixed), lists(worth), less], names=["row", "round", "step", "mixed", "worth", "less"])

    for held in batches:
        every = np.asarray(held.column(1).flatten(), float).reshape(-1, p)
        for at in range(0, len(every), many):
            x, row = every[at:at + many], held.column(0).slice(at, many)
            turns = np.take_along_axis(x[:, None, :] != met, np.broadcast_to(orders, (len(x), rounds, p)), axis=2)
            # The first step from each place on that changes something; p where none does.
            ahead = np.minimum.accumulate(np.where(turns, np.arange(p), p)[:, :, ::-1], axis=2)[:, :, ::-1]
            i, r, s = np.nonzero(turns[:, :, :-1] & (ahead[:, :, 1:] < p))
            n = np.arange(len(i))
            worth = np.zeros((len(i), p))
            worth[n, orders[r, s]] = 1.0
            worth[n, orders[r, ahead[i, r, s + 1]]] = -1.0
            yield batch(row.take(pa.array(i)), r, s, np.where(place[r] <= s[:, None], x[i], met[r]), worth, pa.nulls(len(i), pa.list_(pa.float64())))
            i, r = np.nonzero(ahead[:, :, 0] < p)
            last = p - 1 - np.argmax(turns[:, :, ::-1], axis=2)
            ends = np.bincount(i * p + orders[r, last[i, r]], minlength=len(x) * p).reshape(-1, p).astype(float)
            less = np.bincount(i * p + orders[r, ahead[i, r, 0]], begin[r], len(x) * p).reshape(-1, p)
            none = np.full(len(x), -1)
            yield batch(row, none, none, x, ends, lists(less))


# ---------------------------------------------------------------- importances

def _steps_through(n: int, rounds: int, seed: int) -> list[tuple[int, int]]:
    """Per round a step coprime to ``n`` and an offset: place -> (step x place + offset) mod n visits every place once."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < rounds:
        step, offset = int(rng.integers(1, max(2, n))), int(rng.integers(0, max(1, n)))
        if math.gcd(step, n) == 1 and (step != 1 or n < 3):
            out.append((step, offset))
    return out


def permutation_importance(df: DataFrame, transform, problem_type: str, names: list[str], repeats: int = 5, seed: int = 42, n: int = 10) -> DataFrame:
    """Mean and population deviation of the drop in score when one feature is shuffled across all rows.

    Rows are numbered once in hash order. For every feature and repeat a row takes the value of the row at another
    place, by a one-to-one map of places, so one join and one ``transform`` cover all features and repeats.
    """
    rows = df.select(F.col("row_id").cast("string").alias("row_id"), "label", vector_to_array("features").alias("x"))
    keyed = rows.withColumn("_order", row_token(["row_id"], seed)).withColumn("_tie", F.xxhash64("row_id"))
    placed = cut(with_position(keyed, "_order", "_tie", out="place").select("row_id", "label", "x", (F.col("place") - 1).alias("place")))
    total = placed.count()
    rounds = F.array(*[F.struct(F.lit(r).alias("round"), F.pmod(F.lit(step) * F.col("place") + F.lit(offset), F.lit(total)).alias("partner"))
                       for r, (step, offset) in enumerate(_steps_through(total, repeats, seed))])
    asked = placed.select("row_id", "label", "x", F.explode(rounds).alias("_pick")).select("row_id", "label", "x", "_pick.round", "_pick.partner")
    other = placed.select(F.col("place").alias("partner"), F.col("x").alias("other"))
    met = asked.join(other, "partner")
    each = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    mixed = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("other", i)).otherwise(v))
    shuffled = each.select(F.concat_ws("|", "row_id", "j", "round").alias("row_id"), "label", "j", "round", array_to_vector(mixed).alias("features"))
    plain = placed.select("row_id", "label", F.lit(-1).alias("j"), F.lit(0).alias("round"), array_to_vector("x").alias("features"))
    scores = _scores(transform(shuffled.unionByName(plain)), problem_type)
    base = scores.filter("j = -1").select(F.col("score").alias("base"))
    table = F.array(*[F.lit(c) for c in names])
    drops = scores.filter("j >= 0").join(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("score"))
    out = drops.groupBy(F.get(table, F.col("j")).alias("feature")).agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))
    return top_features(out.withColumn("method_detail", F.lit("Permutation importance")), n=n)


def _scores(predicted: DataFrame, problem_type: str) -> DataFrame:
    """Accuracy or R2 per (feature, repeat)."""
    if problem_type == "classification":
        score = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    else:
        score = 1.0 - F.sum(F.pow(F.col("label") - F.col("prediction"), 2)) / F.nullif(F.var_pop("label") * F.count("label"), F.lit(0.0))
    return predicted.groupBy("j", "round").agg(score.alias("score"))


def native_importance(model, names: list[str], spark, n: int = 10) -> DataFrame:
    values = forest.importances(model) if isinstance(model, Fitted) else model.featureImportances.toArray().tolist()
    rows = [(name, float(v), "Model-native feature importance") for name, v in zip(names, values)]
    return top_features(spark.createDataFrame(rows, "feature string, importance double, method_detail string"), n=n)


# ---------------------------------------------------------------- clusters

def cluster_means(df: DataFrame, cluster: str, columns: list[str], digits: int | None = 4) -> DataFrame:
    """(cluster, size, feature, mean_value), one aggregation; the table is clusters x features long."""
    shown = lambda mean: mean if digits is None else F.round(mean, digits)
    wide = df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), *[shown(F.avg(quoted(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean_value")) for i, c in enumerate(columns)])
    return wide.select("cluster", "size", F.inline(cells))


def cluster_profiles(df: DataFrame, cluster: str, columns: list[str], n: int = 10) -> DataFrame:
    """The features with the largest absolute mean per cluster."""
    order = Window.partitionBy("cluster").orderBy(F.abs("mean_value").desc(), F.col("feature").asc())
    return cluster_means(df, cluster, columns).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def cluster_importance(df: DataFrame, cluster: str, columns: list[str], n: int = 10) -> DataFrame:
    """Sample variance of the cluster means, not of their rounded display."""
    spread = cluster_means(df, cluster, columns, None).groupBy("feature").agg(F.var_samp("mean_value").alias("importance"))
    return top_features(spread.filter(F.col("importance").isNotNull()), n=n)


def cluster_metrics(df: DataFrame, cluster: str) -> DataFrame:
    return df.agg(F.count_distinct(cluster).alias("n_clusters"), F.count(F.lit(1)).alias("total_points"))


# ---------------------------------------------------------------- words

def token_saliency(weights: DataFrame, coefficients: DataFrame, n: int = 10) -> DataFrame:
    """(token, score): sum over all documents of |weight x coefficient|, special tokens left out.

    ``weights`` is (doc, gram, weight); ``coefficients`` (gram, coefficient) is as long as the vocabulary.
    """
    joined = weights.join(F.broadcast(coefficients), "gram").filter(~F.col("gram").isin("<pad>", "<unk>"))
    scores = joined.groupBy(F.col("gram").alias("token")).agg(F.round(F.sum(F.abs(F.col("weight") * F.col("coefficient"))), 4).alias("score"))
    return scores.filter("score > 0").orderBy(F.col("score").desc(), F.col("token")).limit(n)
