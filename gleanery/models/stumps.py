"""Adaptive boosting with stumps (SAMME) on histograms.

Rows are binned and packed once. A row's weight is a sum of votes that its bins look up, so no round has to keep weights: a pass adds
up weights by feature, bin and class, which settles the next stump, its error and its vote.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .base import Context, Fitted, predictor
from .boost import _blocks, cut_points, tasks_for


def _weighed(blocks, given, width: int, bins: int, classes: int) -> np.ndarray:
    """Weights by feature, bin and class over the blocks of a task, rounded to a grid on which sums are exact."""
    votes, offset, grid = given
    total = np.zeros((width, bins * classes))
    for bin_of, y, n in blocks:
        cells = bin_of.astype(np.int64) * classes + y.astype(np.int64)[:, None]
        w = np.exp(sum(votes[f][cells[:, f]] for f in range(width)) - offset) if votes is not None else np.ones(len(y))
        w = np.rint(w * grid) * n
        for f in range(width):
            total[f] += np.bincount(cells[:, f], w, bins * classes)
    return total


def _best_cut(sums: np.ndarray, rows: np.ndarray) -> tuple[int, int] | None:
    """The (feature, bin) after which a cut lowers the Gini impurity most, both sides having rows; equal ones go to the first."""
    def pure(s):
        return (s * s).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1e-300)

    left, n = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(rows.sum(axis=2), axis=1)
    total = sums[0].sum(axis=0)
    gain = pure(left) + pure(total - left) - pure(total)
    gain[(n[:, :-1] == 0) | (n[:, :-1] == n[:, -1:])] = -np.inf
    top = gain.max() if gain.size else -np.inf
    if not top > 1e-12 * total.sum():
        return None
    f, b = divmod(int(np.argmax(gain >= top * (1 - 1e-9))), gain.shape[1])
    return f, b


def fit(df: DataFrame, ctx: Context, rounds: int) -> Fitted:
    classes, width = max(2, ctx.classes), ctx.width
    spark = df.sparkSession
    rows = spread(df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")))
    cuts = cut_points(rows, width, 64)
    bins = max(map(len, cuts), default=0) + 1
    kind = np.uint8 if bins <= 256 else np.uint16
    opened = lambda r: (np.frombuffer(bytes(r["bins"]), kind).reshape(-1, width), np.frombuffer(bytes(r["y"])), np.frombuffer(bytes(r["n"])))
    blocks = _blocks(rows, cuts, width, tasks_for(spark, ctx.n, width)).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def ask(votes, offset, grid):
        given = spark.sparkContext.broadcast((votes, offset, grid))
        sums = blocks.mapPartitions(lambda it: [_weighed(it, given.value, width, bins, classes)])
        total = sums.reduce(np.add) if blocks.getNumPartitions() <= 16 else sums.treeReduce(np.add)
        given.destroy()
        return total.reshape(width, bins, classes) / grid

    counts = sums = ask(None, 0.0, 1.0)
    # Weights add up to one after a round, and to at most ``classes`` before that.
    grid, offset = 2.0 ** (50 - math.ceil(math.log2(classes))), math.log(max(1.0, counts[0].sum()))
    sums = sums / max(1.0, counts[0].sum())
    added = np.zeros((width, bins, classes))
    stumps, votes = [], []
    for r in range(rounds):
        found = _best_cut(sums, counts)
        total = sums[0].sum(axis=0)
        f, b = found or (0, bins - 1)
        left = sums[f, :b + 1].sum(axis=0)
        sides = [left, total - left] if found else [total, total]
        told = [int(np.argmax(s)) for s in sides]
        right = left[told[0]] + (total - left)[told[1]]
        error = max(0.0, 1.0 - right / total.sum())
        if error >= 1.0 - 1.0 / classes and stumps:
            break
        stump = (f, float(cuts[f][b]) if found else math.inf, *told)
        if error >= 1.0 - 1.0 / classes:
            stumps, votes = [stump], [1.0]
            break
        vote = math.log((1.0 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(max(1, classes - 1))
        stumps.append(stump)
        votes.append(vote)
        # What adds up to one with an error below the grid is no error.
        if error <= 1e-12 or r == rounds - 1:
            break
        for at, side in ((slice(0, b + 1), told[0]), (slice(b + 1, None), told[1])):
            added[f, at] += vote
            added[f, at, side] -= vote
        offset += math.log(total.sum())
        sums = ask(list(added.reshape(width, -1)), offset, grid)
    blocks.unpersist()
    return Fitted("ada_stumps", [], {"has_probability": True, "stumps": stumps, "votes": votes, "classes": classes})


@predictor("ada_stumps")
def _ada_stumps(model: Fitted, df: DataFrame) -> DataFrame:
    k, votes = model.params["classes"], model.params["votes"]
    tables = {}
    for f in sorted({s[0] for s in model.params["stumps"]}):
        own = [(s[1], s[2], s[3], v) for s, v in zip(model.params["stumps"], votes) if s[0] == f]
        edges = np.unique([cut for cut, *_ in own])
        share = np.zeros((len(edges) + 1, k))
        for cut, low, high, vote in own:
            at = int(np.searchsorted(edges, cut))
            share[:at + 1, low] += vote
            share[at + 1:, high] += vote
        tables[f] = (edges, share)
    shared = df.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("array<double>")
    def raised(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        x = np.stack(xs.to_numpy())
        share = sum(table[np.searchsorted(edges, x[:, f], "left")] for f, (edges, table) in shared.value.items())
        return pd.Series(list(np.exp((share / sum(votes) * k - 1.0) / (k - 1))))

    out = df.withColumn("_e", raised(vector_to_array("features")))
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    out = out.withColumn("probability", F.transform("_e", lambda v: v / total))
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double")).drop("_e")
