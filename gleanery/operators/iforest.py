"""Isolation forest (Liu, Ting, Zhou 2008): small trees from small samples, scored on all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import numeric_columns, quoted
from ..session import cut, spread
from .quantiles import exact_quantiles

TREES, SAMPLE = 100, 256
RUN, SPACE = 4096, 1 << 40


def _path_constant(n):
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    full = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as flat lists; a leaf has feature -1 and its expected remaining depth added to its depth."""
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    tree = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(tree["feature"])
        if parent is not None:
            tree[side][parent] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or len(open_features) == 0
        f = -1 if leaf else int(rng.choice(open_features))
        cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        tree["feature"].append(f)
        tree["threshold"].append(cut)
        tree["left"].append(-1)
        tree["right"].append(-1)
        tree["depth"].append(float(depth + _path_constant(len(rows))) if leaf else 0.0)
        if not leaf:
            goes = x[rows, f] <= cut
            todo += [(rows[goes], depth + 1, node, "left"), (rows[~goes], depth + 1, node, "right")]
    return tree


def fit_forest(df: DataFrame, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> tuple[list[dict], int]:
    """Grow each tree on its own bounded sample, in its own task.

    One rule at every size: copies of a row are numbered, so a row is named by its cells and its number, and a tree
    draws the ``sample`` rows whose token with the tree's number is smallest. The draw knows nothing of files or
    partitions. Rows with a token beyond three times the wanted share cannot be among the smallest and never leave
    their task; a tree that found too few anyway (as good as never) draws from all rows.
    """
    x = F.array(*[F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x")
    counts = cut(df.select(x).groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
    n = counts.agg(F.sum("copies").alias("n")).first()["n"]
    size = min(sample, n)

    # Copies come in runs of bounded length; runs beyond a row's first are dealt out, as one row may own a third of the table.
    first = counts.select("x", F.lit(0).cast("long").alias("run"), F.least("copies", F.lit(RUN)).alias("many"))
    more = counts.filter(F.col("copies") > RUN).select("x", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("run"))
    more = more.select("x", "run", F.least(F.col("copies") - F.col("run") * RUN, F.lit(RUN)).alias("many")).repartition("x", "run")
    each = first.unionByName(more).select("x", "run", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))).alias("place"))
    named = each.select("x", F.xxhash64(F.lit(seed), "x", "run", "place").alias("name"))

    def drawn(share: float, wanted: list[int]) -> DataFrame:
        """(x, tree, token): the trees among ``wanted`` for which a row's token lies below ``share``."""
        tokens = F.transform(F.array(*[F.lit(t) for t in wanted]), lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64("name", t), F.lit(SPACE)).alias("token")))
        return named.select("x", F.explode(F.filter(tokens, lambda p: p["token"] < F.lit(int(share * SPACE)))).alias("p")).select("x", "p.tree", "p.token")

    dealt = cut(drawn(min(1.0, 3.0 * size / n), list(range(trees))))
    enough = {r["tree"] for r in dealt.groupBy("tree").count().filter(F.col("count") >= size).select("tree").collect()}
    short = [t for t in range(trees) if t not in enough]
    if short:
        dealt = cut(dealt.filter(~F.col("tree").isin(short)).unionByName(drawn(1.0, short)))

    def build(key, pdf):
        rng = np.random.default_rng(seed * 100_003 + int(key[0]))
        smallest = sorted(zip(pdf["token"], map(tuple, pdf["x"])))[:size]
        points = np.array(sorted(p for _, p in smallest), dtype=float)
        return pd.DataFrame([{**_grow(points, rng), "tree": int(key[0])}])

    schema = "feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>, tree int"
    grown = dealt.groupBy("tree").applyInPandas(build, schema).orderBy("tree").collect()  # trees x (2 * sample) nodes
    return [{k: np.array(r[k]) for k in ("feature", "threshold", "left", "right", "depth")} for r in grown], size


def score_column(df: DataFrame, columns: list[str], forest: list[dict], size: int) -> Column:
    """Anomaly score in (0, 1]; higher is stranger. Whole batches walk the trees level by level."""
    shared = df.sparkSession.sparkContext.broadcast((forest, float(_path_constant(size)) or 1.0))

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        trees, norm = shared.value
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        depth = np.zeros(len(x))
        for t in trees:
            node = np.zeros(len(x), dtype=int)
            while True:
                f = t["feature"][node]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.where(inner, f, 0)] <= t["threshold"][node]
                node = np.where(inner, np.where(goes, t["left"][node], t["right"][node]), node)
            depth += t["depth"][node]
        return pd.Series(2.0 ** (-depth / (len(trees) * norm)))

    return score(*[F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in columns])


def detect_anomalies(df: DataFrame, contamination: float = 0.02, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = 42, with_score: bool = False) -> DataFrame:
    """Add ``is_anomaly``: 1 where the score lies above the (1 - contamination) quantile of all scores."""
    columns = numeric_columns(df)
    if not columns or df.isEmpty():
        return df.withColumn("is_anomaly", F.lit(0))
    df = spread(df)
    forest, size = fit_forest(df, columns, trees, sample, seed)
    # Written once: rows walk the trees a single time, for the quantile and for the output.
    scored = cut(df.withColumn("anomaly_score", score_column(df, columns, forest, size)))
    limit = exact_quantiles(scored.select("anomaly_score"), ["anomaly_score"], 1.0 - contamination)["anomaly_score"]
    out = scored.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(limit)).cast("int"))
    return out if with_score else out.drop("anomaly_score")
