"""Exact nearest neighbours as a partitioned join.

Reference rows are cut into cells around a bounded set of pivots, and each cell keeps a bounding box.
For a query, the boxes give a lower and an upper bound on the distance to every row of a cell. Cells whose
lower bound exceeds the smallest radius that certainly holds ``k`` rows cannot contribute and are skipped;
the query is sent to the rest. Boxes work coordinate by coordinate, so rows with missing coordinates are
handled too: they are grouped by which coordinates they have. Big cells, and long query lists for one
cell, are dealt into blocks, and a task sees one block of each side and returns only its best ``k``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut, spread

BLOCK = 4096
MAX_PIVOTS = 1024
MAX_MASKS = 64


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column; a missing coordinate is NaN."""
    return np.array(column.tolist(), dtype=float)


class _Near:
    """The ``k`` nearest of a block of rows by euclidean distance; with missing coordinates, over the shared ones and scaled up to all.

    They are found by matrix products: the sum of squares over shared coordinates is that of both sides less twice the inner product,
    with zeros for what is missing. It is off by rounding alone, so every row whose value lies within the error of the ``k``-th
    smallest is then measured coordinate by coordinate.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.width = rows, rows.shape[1]
        with np.errstate(invalid="ignore"):
            middle = np.nan_to_num(np.nanmean(rows, axis=0)) if len(rows) and not np.isnan(rows).all(axis=0).any() else np.zeros(self.width)
        self.middle, self.has = middle, ~np.isnan(rows)
        self.x = np.where(self.has, rows - middle, 0.0)
        self.full = bool(self.has.all())
        self.square = self.x * self.x

    def find(self, queries: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance), queries in order, nearest first and ties in the order of the rows; ``allowed`` marks rows for each query."""
        has = ~np.isnan(queries)
        q = np.where(has, queries - self.middle, 0.0)
        if self.full and has.all():
            scale = 1.0
            total = (q * q).sum(axis=1)[:, None] + self.square.sum(axis=1) - 2 * (q @ self.x.T)
            usable = np.ones(total.shape, bool) if allowed is None else allowed
            most = (q * q).sum(axis=1) + self.square.sum(axis=1).max()
        else:
            there, mine = self.has.astype(float), has.astype(float)
            shared = mine @ there.T
            scale = self.width / np.maximum(shared, 1.0)
            total = ((q * q) @ there.T + mine @ self.square.T - 2 * (q @ self.x.T)) * scale
            usable = shared > 0 if allowed is None else (shared > 0) & allowed
            most = ((q * q).sum(axis=1) + self.square.sum(axis=1).max()) * self.width
        total[~usable] = np.inf
        slack = most * (8 * (self.width + 4) * np.finfo(float).eps)
        last = np.partition(total, min(k, total.shape[1]) - 1, axis=1)[:, min(k, total.shape[1]) - 1]
        near = (total <= (last + 2 * slack)[:, None]) & usable
        asked, places = np.nonzero(near)
        sums, shared = np.zeros(len(asked)), np.zeros(len(asked))
        for j in range(self.width):
            d = queries[asked, j] - self.rows[places, j]
            ok = ~np.isnan(d)
            sums += np.where(ok, d * d, 0.0)
            shared += ok
        distance = np.sqrt(sums * (self.width / shared))
        order = np.lexsort((places, distance, asked))
        asked, places, distance = asked[order], places[order], distance[order]
        keep = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        return asked[keep], places[keep], distance[keep]


def _bounds_to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible distance from each row of ``x`` to each box (NaN sides are missing)."""
    near, far, shared = (np.zeros((len(x), len(low))) for _ in range(3))
    for j in range(x.shape[1]):
        v, lo, hi = x[:, j:j + 1], low[None, :, j], high[None, :, j]
        ok = ~(np.isnan(v) | np.isnan(lo))
        near += np.where(ok, np.maximum(np.maximum(lo - v, v - hi), 0.0) ** 2, 0.0)
        far += np.where(ok, np.maximum(np.abs(v - lo), np.abs(v - hi)) ** 2, 0.0)
        shared += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(shared > 0, x.shape[1] / shared, np.nan)
    return np.sqrt(near * scale), np.sqrt(far * scale)


def _with_cells(train: DataFrame, n_train: int, width: int, block: int) -> DataFrame:
    """Add the cell (nearest pivot, which coordinates are present) to each reference row."""
    n_pivots = int(min(MAX_PIVOTS, max(1, n_train // block)))
    pivots = [r["x"] for r in train.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(n_pivots).collect()]
    centres = np.nan_to_num(_matrix(pd.Series(pivots)))
    shared = train.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest_pivot(x: pd.Series) -> pd.Series:
        c = shared.value
        m = np.nan_to_num(_matrix(x)).reshape(-1, width)
        return pd.Series(np.concatenate([((c * c).sum(axis=1) - 2 * (m[i:i + 1024] @ c.T)).argmin(axis=1) for i in range(0, max(1, len(m)), 1024)]), dtype="int32")

    present = F.concat_ws("", F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1")))
    out = train.withColumn("mask", present)
    # Rare patterns share one class whose box says nothing, which keeps the box table bounded.
    common = [r["mask"] for r in out.groupBy("mask").count().orderBy(F.desc("count"), "mask").limit(MAX_MASKS).collect()]
    out = out.withColumn("mask", F.when(F.col("mask").isin(common), F.col("mask")).otherwise("other"))
    return out.withColumn("cell", nearest_pivot("x") if n_pivots > 1 else F.lit(0))


def nearest(train: DataFrame, queries: DataFrame, k: int, width: int, per_missing: bool = False, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest reference rows of every query.

    ``train`` has (id, x array<double>, payload double), ``queries`` has (id, x). Ties go to the smaller id.
    With ``per_missing`` a search is made for each missing coordinate of a query, among the rows that have
    that coordinate, and the payload is that coordinate's value. The result has
    (id, want, neighbour, distance, payload, rank); ``want`` is the coordinate searched for, or -1.
    """
    train, queries = spread(train), spread(queries)
    # Rows alike are equally far, so of each only the ``k`` smallest ids can be an answer; the limit is taken below the shuffle too.
    alike = Window.partitionBy("x").orderBy("id")
    train = train.withColumn("_place", F.row_number().over(alike)).filter(F.col("_place") <= k).drop("_place")
    n_train = train.count()
    placed = cut(_with_cells(train, n_train, width, block))
    boxes = placed.groupBy("cell", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.col("x")[j]) for j in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[j]) for j in range(width)]).alias("high"),
    ).orderBy("cell", "mask").collect()  # at most MAX_PIVOTS x (MAX_MASKS + 1) boxes
    id_type = queries.schema["id"].dataType.simpleString()
    train_id = train.schema["id"].dataType.simpleString()
    table = {
        "n": np.array([b["n"] for b in boxes], dtype=float),
        "low": _matrix(pd.Series([b["low"] for b in boxes])), "high": _matrix(pd.Series([b["high"] for b in boxes])),
        "vague": np.array([b["mask"] == "other" for b in boxes]),
        "has": np.array([[b["mask"] != "other" and b["mask"][j] == "1" for j in range(width)] for b in boxes]),
    }
    shared = train.sparkSession.sparkContext.broadcast(table)

    def route(batches):
        t = shared.value
        for pdf in batches:
            out = {"id": [], "x": [], "want": [], "box": []}
            x = _matrix(pdf["x"])
            near, far = _bounds_to_boxes(x, t["low"], t["high"])
            near[:, t["vague"]], far[:, t["vague"]] = 0.0, np.inf
            for i in range(len(pdf)):
                wants = np.flatnonzero(np.isnan(x[i])) if per_missing else [-1]
                for w in wants:
                    usable = ~np.isnan(near[i])
                    sure = usable & ~t["vague"]
                    if w >= 0:
                        sure &= t["has"][:, w]
                        usable &= t["has"][:, w] | t["vague"]
                    order = np.argsort(np.where(sure, far[i], np.inf), kind="stable")
                    reached = np.cumsum(np.where(sure, t["n"], 0.0)[order]) >= k
                    radius = far[i][order[np.argmax(reached)]] if reached.any() else np.inf
                    hits = np.flatnonzero(usable & (near[i] <= radius * (1 + 1e-9) + 1e-12))
                    out["id"] += [pdf["id"].iloc[i]] * len(hits)
                    out["x"] += [pdf["x"].iloc[i]] * len(hits)
                    out["want"] += [int(w)] * len(hits)
                    out["box"] += hits.tolist()
            yield pd.DataFrame(out)

    routed = cut(queries.select("id", "x").mapInPandas(route, f"id {id_type}, x array<double>, want int, box int"))
    loads = routed.groupBy("box").agg(F.count(F.lit(1)).alias("m")).collect()
    plan = [(b["cell"], b["mask"], i, max(1, -(-b["n"] // block)), 1) for i, b in enumerate(boxes)]
    query_blocks = {r["box"]: max(1, -(-r["m"] // block)) for r in loads}
    plan = [(c, m, i, s, int(query_blocks.get(i, 0))) for c, m, i, s, _ in plan]
    layout = train.sparkSession.createDataFrame(plan, "cell int, mask string, box int, train_blocks long, query_blocks long")
    layout = F.broadcast(layout.filter("query_blocks > 0"))

    right = placed.join(layout, ["cell", "mask"]).select(
        "id", "x", "payload", "box", F.pmod(F.xxhash64("id"), F.col("train_blocks")).alias("s"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("t"))
    left = routed.join(layout, "box").select(
        "id", "x", "want", "box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("train_blocks") - 1)).alias("s"),
        F.pmod(F.xxhash64("id", "want"), F.col("query_blocks")).alias("t"))

    def best_of_block(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "want": [], "neighbour": [], "distance": [], "payload": []})]
        if len(q) and len(r):
            r = r.sort_values("id", kind="stable")
            rx, ids, pay = _matrix(r["x"]), r["id"].to_numpy(), r["payload"].to_numpy(dtype=float)
            near, qx, names, wants, there = _Near(rx), _matrix(q["x"]), q["id"].to_numpy(), q["want"].to_numpy(), ~np.isnan(rx).T
            for start in range(0, len(q), 256):
                asked, take, d = near.find(qx[start:start + 256], k, there[wants[start:start + 256]] if per_missing else None)
                asked = asked + start
                out.append(pd.DataFrame({"id": names[asked], "want": wants[asked], "neighbour": ids[take], "distance": d,
                                         "payload": rx[take, wants[asked]] if per_missing else pay[take]}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("box", "s", "t").cogroup(right.groupBy("box", "s", "t")).applyInPandas(
        best_of_block, f"id {id_type}, want int, neighbour {train_id}, distance double, payload double")
    order = Window.partitionBy("id", "want").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _vector_of(columns: list[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def impute_knn(df: DataFrame, key: str, columns: list[str], k: int = 5, block: int = BLOCK) -> DataFrame:
    """Fill numeric gaps with the mean of the ``k`` nearest rows that have the value; else the column mean."""
    base = df.select(F.col(key).alias("id"), _vector_of(columns).alias("x"), F.lit(None).cast("double").alias("payload"))
    gaps = base.filter(F.exists("x", lambda v: v.isNull()))
    found = nearest(base, gaps, k, len(columns), per_missing=True, block=block)
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    fills = found.groupBy("id").agg(*[
        F.avg(F.when(F.col("want") == j, F.col("payload"))).alias(f"_fill{j}") for j in range(len(columns))])
    joined = df.join(fills, df[key] == fills["id"], "left")
    return joined.select(*[
        F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"_fill{columns.index(c)}"), F.lit(means[f"m{columns.index(c)}"])).alias(c)
        if c in columns else df[c] for c in df.columns])


def knn_classify(train: DataFrame, queries: DataFrame, width: int, k: int = 7, block: int = BLOCK) -> DataFrame:
    """Majority vote of the ``k`` nearest rows, the smaller class on a tie; shares of the votes as well."""
    votes = nearest(train, queries, k, width, block=block).groupBy("id", "payload").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("id").agg(
        F.min_by("payload", F.struct(-F.col("votes"), F.col("payload"))).alias("prediction"),
        (F.max("votes") / F.sum("votes")).alias("vote_share"),
        F.map_from_entries(F.collect_list(F.struct("payload", "votes"))).alias("votes"))


def knn_regress(train: DataFrame, queries: DataFrame, width: int, k: int = 7, block: int = BLOCK) -> DataFrame:
    return nearest(train, queries, k, width, block=block).groupBy("id").agg(F.avg("payload").alias("prediction"))
