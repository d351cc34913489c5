"""Clustering. Input frames have ``row_id`` and ``x`` (array<double>); every method returns (row_id, x, cluster)."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.evaluate import silhouette
from ..session import cut, keep
from .kmeans import best_of, fit_runs

SUMMARIES = 500


def fit_sweep(df: DataFrame, ks: Iterable[int], starts: int = 10, seed: int = 42) -> dict[int, DataFrame]:
    """K-means for each k, the cheapest of several starts; all of them are trained side by side."""
    best = best_of(fit_runs(df, [(k, seed + s) for k in ks for s in range(starts)]))
    return {k: _assign_nearest(df, run.centres, np.arange(len(run.centres))) for k, run in best.items()}


def fit_kmeans(df: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    return fit_sweep(df, [k], starts, seed)[k]


def sweep_range(n: int) -> range:
    """Numbers of clusters worth trying for ``n`` rows."""
    return range(2, min(10, max(3, n // 5)))


def fit_gaussian_mixture(df: DataFrame, k: int = 3, seed: int = 42, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> DataFrame:
    """Full covariances, from the groups that k-means finds; a poor draw of means would leave well separated groups merged.

    Each round is one pass over the rows: every task adds up shares, sums and products of its rows, and the driver solves for
    ``k`` means and covariances. It ends when the mean log-likelihood changes by less than ``tolerance``.
    """
    first = df.select(F.size("x").alias("n")).first()
    if first is None:
        return df.select("row_id", "x", F.lit(0).cast("long").alias("cluster"))
    width = first["n"]
    start = fit_kmeans(df, k, 3, seed).select("x", "cluster")
    cells = width * width + width + 1
    rows = keep(df.select("x"))

    def sums(frame: DataFrame, shares) -> tuple[np.ndarray, float, int]:
        def run(batches):
            total, likelihood, n = np.zeros((k, cells)), 0.0, 0
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["x"].to_numpy())
                    share, log = shares(pdf, x)
                    full = np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], axis=1)
                    total, likelihood, n = total + share.T @ full, likelihood + log, n + len(x)
            yield pd.DataFrame({"s": [total.ravel().tolist()], "log": [likelihood], "n": [n]})

        got = frame.mapInPandas(run, "s array<double>, log double, n long")
        row = got.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k * cells)], F.sum("log").alias("log"), F.sum("n").alias("n")).first()
        return np.array([row[f"s{i}"] for i in range(k * cells)]).reshape(k, cells), row["log"], row["n"]

    def solved(total: np.ndarray, n: int):
        weight = total[:, 0] + 10 * np.finfo(float).eps
        mean = total[:, 1:1 + width] / weight[:, None]
        spread = total[:, 1 + width:].reshape(k, width, width) / weight[:, None, None] - mean[:, :, None] * mean[:, None, :]
        return weight / n, mean, spread + floor * np.eye(width)

    def shares_of(model):
        weight, mean, spread = model
        factor = np.linalg.cholesky(np.linalg.inv(spread))
        offset = np.log(weight) + np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1) - width * math.log(2 * math.pi) / 2

        def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            log = offset - 0.5 * (np.einsum("nkd,kde->nke", x[:, None, :] - mean, factor) ** 2).sum(axis=2)
            top = log.max(axis=1, keepdims=True)
            whole = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
            return np.exp(log - whole[:, None]), whole

        return shares

    total, _, n = sums(start, lambda pdf, x: (np.eye(k)[pdf["cluster"].to_numpy()], 0.0))
    model, before = solved(total, n), -np.inf
    for _ in range(rounds):
        shares = shares_of(model)
        total, log, n = sums(rows, lambda pdf, x: (lambda s: (s[0], float(s[1].sum())))(shares(x)))
        model = solved(total, n)
        if abs(log / n - before) < tolerance:
            break
        before = log / n
    shares = shares_of(model)
    rows.unpersist()

    @F.pandas_udf("long")
    def likeliest(x: pd.Series) -> pd.Series:
        return pd.Series(shares(np.stack(x.to_numpy()))[0].argmax(axis=1) if len(x) else [], dtype="int64")

    return df.select("row_id", "x", likeliest("x").alias("cluster"))


# ---------------------------------------------------------------- hierarchical, over summaries

def ward_labels(centres: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Merge the pair whose union adds least variance until ``k`` groups are left. Input is a few hundred summaries."""
    groups = [[i] for i in range(len(centres))]
    c, w = centres.astype(float).copy(), weights.astype(float).copy()
    d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    np.fill_diagonal(d, np.inf)
    alive = len(groups)
    while alive > k:
        i, j = divmod(int(np.argmin(d)), len(c))
        c[i] = (w[i] * c[i] + w[j] * c[j]) / (w[i] + w[j])
        w[i] += w[j]
        groups[i], groups[j] = groups[i] + groups[j], []
        d[j, :] = d[:, j] = np.inf
        live = np.isfinite(d[i]) & (np.arange(len(c)) != i)
        d[i, live] = d[live, i] = (((c[live] - c[i]) ** 2).sum(axis=1)) * (w[live] * w[i] / (w[live] + w[i]))
        alive -= 1
    labels = np.empty(len(centres), dtype=int)
    for number, members in enumerate(sorted((g for g in groups if g), key=min)):
        labels[members] = number
    return labels


def _assign_nearest(df: DataFrame, centres: np.ndarray, labels: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((centres, labels))

    @F.pandas_udf("long")
    def nearest(x: pd.Series) -> pd.Series:
        c, names = shared.value
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, c.shape[1]))
        place, best = np.zeros(len(m), dtype=int), np.full(len(m), np.inf)
        for i, centre in enumerate(c):
            d = ((m - centre) ** 2).sum(axis=1)
            place[d < best] = i
            np.minimum(best, d, out=best)
        return pd.Series(names[place], dtype="int64")

    return df.select("row_id", "x", nearest("x").alias("cluster"))


def fit_agglomerative(df: DataFrame, k: int = 3, summaries: int = SUMMARIES, seed: int = 42) -> DataFrame:
    """Ward clustering. Up to ``summaries`` distinct rows are merged as they are; more are first summarised by that
    many weighted centres, so the merge itself is of bounded size."""
    distinct = df.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    centres, labels = ward_of_weighted(distinct, k, summaries, seed)
    if len(centres) == 0:
        return df.select("row_id", "x", F.lit(0).cast("long").alias("cluster"))
    return _assign_nearest(df, centres, labels)


def fit_birch(df: DataFrame, width: int, k: int = 3, threshold: float = 0.5, summaries: int = SUMMARIES, seed: int = 42) -> DataFrame:
    """Clustering features (count, sum) of cells whose radius is at most ``threshold``, then Ward over them.

    Cells are a grid with diagonal 2 x threshold, so the summaries are one aggregation and do not depend on row
    order. More cells than ``summaries`` are merged by weighted centres before the hierarchy.
    """
    side = 2.0 * threshold / max(1, width) ** 0.5
    cell = F.transform("x", lambda v: F.floor(v / side))
    features = df.withColumn("_cell", cell).groupBy("_cell").agg(
        F.count(F.lit(1)).cast("double").alias("w"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(width)])
    centres = features.select("_cell", "w", F.array(*[F.col(f"s{j}") / F.col("w") for j in range(width)]).alias("x"))
    labelled = ward_of_weighted(centres, k, summaries, seed)
    return _assign_nearest(df, *labelled)


def ward_of_weighted(points: DataFrame, k: int, summaries: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ward over weighted points (x, w), summarised first when there are more than ``summaries``."""
    points = keep(points)
    if points.count() <= summaries:
        rows = points.orderBy("x").collect()
        centres, weights = np.array([r["x"] for r in rows], dtype=float), np.array([r["w"] for r in rows])
    else:
        run, = fit_runs(points, [(summaries, seed)], "x", "w", 50)
        centres, weights = run.centres[run.weights > 0], run.weights[run.weights > 0]
    return centres, ward_labels(centres, weights, min(k, len(centres)))


# ---------------------------------------------------------------- density

def _grid_neighbours(cells: DataFrame, width: int, eps: float) -> DataFrame:
    """Pairs of cells (a, b) that may hold rows within ``eps`` of each other, each pair in both directions.

    Cells are no wider than ``eps``, so the low corners of two such cells differ by at most twice that. They are
    matched through a coarse grid of that side over at most three coordinates, whose neighbourhood is 27
    cells; the boxes of the cells then decide.
    """
    dims = min(3, width)
    coarse = [F.floor(F.col("low")[j] / (2 * eps)).cast("long") for j in range(dims)]
    steps = list(product([-1, 0, 1], repeat=dims))
    left = cells.select(F.col("cell").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"),
                        F.explode(F.array(*[F.array(*[coarse[j] + s[j] for j in range(dims)]) for s in steps])).alias("key"))
    right = cells.select(F.col("cell").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.array(*coarse).alias("key"))
    gap2 = _box_gap("a", "b")
    return left.join(right, "key").filter(gap2 <= eps * eps * (1 + 1e-9)).drop("key")


def _box_gap(a: str, b: str):
    """Squared smallest distance between two boxes."""
    up = F.zip_with(f"{a}_low", f"{b}_high", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0)))
    down = F.zip_with(f"{b}_low", f"{a}_high", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0)))
    return F.aggregate(F.zip_with(up, down, lambda u, d: F.greatest(u, d)), F.lit(0.0), lambda s, v: s + v * v)


def _box_span(a: str, b: str):
    """Squared largest distance between two boxes."""
    one = F.zip_with(f"{a}_high", f"{b}_low", lambda hi, lo: F.abs(hi - lo))
    two = F.zip_with(f"{b}_high", f"{a}_low", lambda hi, lo: F.abs(hi - lo))
    return F.aggregate(F.zip_with(one, two, lambda u, d: F.greatest(u, d)), F.lit(0.0), lambda s, v: s + v * v)


def _distance2(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _boxes(points: DataFrame, cell: str, width: int, extra: list | None = None) -> DataFrame:
    return points.groupBy(cell).agg(
        F.sum("w").alias("n"), F.array(*[F.min(F.col("x")[j]) for j in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[j]) for j in range(width)]).alias("high"), *(extra or []))


def core_points(df: DataFrame, width: int, eps: float = 0.8, min_samples: int = 5) -> DataFrame:
    """(x, w, cell, neighbours, is_core) per distinct point, ``w`` being its number of rows.

    Cells have diagonal ``eps``: all rows of a cell are neighbours. A cell with ``min_samples`` rows is core
    throughout, however many rows it holds, and never compared pair by pair. Points of sparse cells (fewer than
    ``min_samples`` rows each) are counted against the boxes and points of the cells around them; a
    box that lies wholly within reach counts with its size.
    """
    side = eps / width ** 0.5 * (1 - 1e-9)
    points = df.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    points = cut(points.withColumn("cell", F.transform("x", lambda v: F.floor(v / side).cast("long"))))
    cells = cut(_boxes(points, "cell", width))
    dense = cells.filter(F.col("n") >= min_samples).select("cell", F.lit(True).alias("dense"))
    tagged = points.join(dense, "cell", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    sparse_cells = cells.filter(F.col("n") < min_samples)
    near = cut(_grid_neighbours(cells, width, eps).join(sparse_cells.select(F.col("cell").alias("a")), "a", "left_semi"))
    sizes = cells.select(F.col("cell").alias("b"), F.col("n").alias("b_n"))
    sparse_points = tagged.filter(~F.col("dense")).select(F.col("cell").alias("a"), F.col("x").alias("px"))
    reach = sparse_points.join(near.select("a", "b", "b_low", "b_high"), "a").join(sizes, "b")
    reach = reach.withColumn("p_low", F.col("px")).withColumn("p_high", F.col("px"))
    gap, span = _box_gap("p", "b"), _box_span("p", "b")
    reach = cut(reach.filter(gap <= eps * eps).withColumn("whole", span <= eps * eps).select("px", "b", "b_n", "whole"))
    whole = reach.filter("whole").groupBy("px").agg(F.sum("b_n").alias("n"))
    parts = reach.filter("not whole").join(points.select(F.col("cell").alias("b"), "x", "w"), "b")
    partly = parts.filter(_distance2("px", "x") <= eps * eps).groupBy("px").agg(F.sum("w").alias("n"))
    counted = whole.unionByName(partly).groupBy("px").agg(F.sum("n").alias("neighbours"))
    joined = tagged.join(counted, tagged["x"] == counted["px"], "left").drop("px")
    return joined.withColumn("is_core", F.col("dense") | (F.coalesce("neighbours", F.lit(0)) >= min_samples))


def _links(core: DataFrame, width: int, eps: float, fine: int = 8) -> DataFrame:
    """Pairs of core cells (a < b) with two core points within ``eps``.

    Each cell is cut into finer boxes first. Two fine boxes that lie wholly within reach settle the pair of cells;
    only pairs that stay open are compared point by point, and only in fine boxes that may touch.
    """
    side = eps / width ** 0.5 / fine
    marked = core.withColumn("fine", F.transform("x", lambda v: F.floor(v / side).cast("long")))
    cells = _boxes(marked, "cell", width)
    pairs = _grid_neighbours(cells, width, eps).select("a", "b").filter(F.array_join("a", ",") < F.array_join("b", ","))
    boxes = cut(marked.groupBy("cell", "fine").agg(
        F.array(*[F.min(F.col("x")[j]) for j in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[j]) for j in range(width)]).alias("high")))
    one = boxes.select(F.col("cell").alias("a"), F.col("fine").alias("a_fine"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    two = boxes.select(F.col("cell").alias("b"), F.col("fine").alias("b_fine"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    met = pairs.join(one, "a").join(two, "b").filter(_box_gap("a", "b") <= eps * eps * (1 + 1e-9))
    met = cut(met.select("a", "b", "a_fine", "b_fine", (_box_span("a", "b") <= eps * eps).alias("sure")))
    settled = met.filter("sure").select("a", "b").distinct()
    open_pairs = met.join(settled, ["a", "b"], "left_anti")
    px = marked.select(F.col("cell").alias("a"), F.col("fine").alias("a_fine"), F.col("x").alias("ax"))
    py = marked.select(F.col("cell").alias("b"), F.col("fine").alias("b_fine"), F.col("x").alias("bx"))
    touching = open_pairs.join(px, ["a", "a_fine"]).join(py, ["b", "b_fine"]).filter(_distance2("ax", "bx") <= eps * eps)
    return settled.unionByName(touching.select("a", "b").distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node is connected to.

    Alternating large-star and small-star steps (Kiveris et al. 2014) shorten paths quickly; only minima are kept
    per node, so a hub is never gathered in one place. Each round is written out.
    """
    pairs = cut(edges.select(F.col("a").cast("string").alias("u"), F.col("b").cast("string").alias("v")).filter("u <> v"))
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    state = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = small_in.groupBy("u").agg(F.min("v").alias("m"))
        moved = small_in.join(low, "u")
        pairs = cut(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
                    .filter("u <> v").distinct())
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))


def fit_dbscan(df: DataFrame, width: int, eps: float = 0.8, min_samples: int = 5) -> DataFrame:
    """Density clusters; noise is -1. Clusters are numbered by their smallest cell; a border point joins the cluster of
    its nearest core point."""
    points = cut(core_points(df, width, eps, min_samples).select("x", "w", "cell", "is_core"))
    core = cut(points.filter("is_core"))
    links = _links(core, width, eps).select(F.to_json("a").alias("a"), F.to_json("b").alias("b"))
    roots = connected_components(links)
    cells = core.select("cell", F.to_json("cell").alias("node")).distinct().join(roots, "node", "left").select("cell", F.coalesce("root", "node").alias("root"))
    cells = cut(cells)
    border = points.filter(~F.col("is_core")).select("x", "cell")
    around = _grid_neighbours(_boxes(points, "cell", width), width, eps).select("a", "b")
    candidates = border.select(F.col("x").alias("px"), F.col("cell").alias("a")).join(around, "a").join(
        core.select(F.col("cell").alias("b"), "x"), "b")
    reached = candidates.withColumn("d", _distance2("px", "x")).filter(F.col("d") <= eps * eps)
    attached = reached.groupBy("px").agg(F.min_by("b", F.struct("d", "x")).alias("cell"))
    placed = core.select("x", "cell").unionByName(attached.select(F.col("px").alias("x"), "cell")).join(cells, "cell").select("x", "root")
    # One row per cluster is numbered.
    numbers = cells.select("root").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("long"))
    labelled = placed.join(numbers, "root").select("x", "cluster")
    return df.join(labelled, "x", "left").select("row_id", "x", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


# ---------------------------------------------------------------- choice

def judge(assigned: DataFrame, name: str, bank: bool) -> DataFrame:
    """(model, family, silhouette_score, n_labels, noise_share) of one clustering."""
    facts = assigned.agg(F.count_distinct("cluster").alias("n_labels"),
                         F.avg((F.col("cluster") == -1).cast("double")).alias("noise_share"))
    score = silhouette(assigned, "x", "cluster")
    return facts.join(F.broadcast(score.select(F.col("silhouette").alias("silhouette_score"), "metric"))).select(
        F.lit(name).alias("model"), F.lit("clustering").alias("family"), "silhouette_score", "n_labels", "noise_share",
        F.lit(bank).alias("from_bank"), "metric")


def select_clusterings(board: DataFrame) -> DataFrame:
    """Drop clusterings with one label, and bank methods that call more than half of the rows noise; best score first."""
    ok = (F.col("n_labels") >= 2) & ~(F.col("from_bank") & (F.col("noise_share") > 0.5))
    return board.filter(ok).select("model", "family", "silhouette_score").orderBy(F.col("silhouette_score").desc(), F.col("model"))
