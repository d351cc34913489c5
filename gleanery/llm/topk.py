"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, the kth score carried from shard to shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

SHARD_ROWS = 4096
QUERY_ROWS = 512
LEAF_ROWS = 64


class KdTree:
    """Median splits along the widest side, with the tight bounding box of every node."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.low, self.high, self.members, self.children = [], [], [], []
        todo = [np.arange(len(vectors))]
        while todo:
            own = todo.pop(0)
            here = vectors[own]
            low, high = here.min(axis=0), here.max(axis=0)
            self.low.append(low), self.high.append(high)
            widest = int(np.argmax(high - low))
            if len(own) <= leaf or low[widest] == high[widest]:
                self.members.append(own), self.children.append(None)
                continue
            order = own[np.argsort(here[:, widest], kind="stable")]
            first = len(self.low) + len(todo)
            self.members.append(None), self.children.append((first, first + 1))
            todo += [order[:len(order) // 2], order[len(order) // 2:]]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score that any point of each node's box could reach, for every query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, row: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) among points other than ``row``; nodes that cannot reach ``floor`` or the kth score are left out."""
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if -reach < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            own = self.members[node]
            scores = self.vectors[own] @ query
            near = (scores >= floor) & (self.rows[own] != row)
            best += zip((-scores[near]).tolist(), self.ids[own][near].tolist())
            best.sort()
            del best[k:]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        return [(-score, i) for score, i in best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def vectors_of(table: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """(row, vec_id, x): integer vectors of the rows that take part, with a number that tells repeated rows apart."""
    whole = F.col(vector).isNotNull() & F.col(id_column).isNotNull() & (F.size(vector) > 0)
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    kept = table.filter(whole).filter(sound)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"),
                       F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``, ties to the smaller vec_id.

    Both have (row, vec_id, x); a query never meets the row it is. Rows lie in shards by a hash; every query searches one
    shard first, and its kth score there is the floor in all others, so boxes below it are not opened. Blocks of queries
    meet shards; only k rows per query and shard leave a task. Vectors of different lengths never meet. Repeated rows are
    rows of their own, as queries too. Scores are exact while they stay below 2^53. Fewer than k candidates give fewer rows;
    an empty table gives an empty result.
    """
    n = max(1, vectors.count())
    shards = -(-n // shard_rows)
    width = F.size("x")

    def shard_of(salt: int):
        return F.concat_ws(":", width.cast("string"), F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(shards)).cast("string"))

    stored = vectors.withColumn("shard", shard_of(1))
    home = queries.withColumn("home", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(shards)))
    schema = "row long, query_id long, vec_id long, score long, kth long"

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: queries with the shard and floor to search."""
        def run(left, right):
            names = ["row", "query_id", "vec_id", "score", "kth"]
            out = {c: [] for c in names}
            if left.num_rows and right.num_rows:
                tree = KdTree(_matrix(left["x"]).astype(np.float64), left["vec_id"].to_numpy(), left["row"].to_numpy())
                x, rows, ids = _matrix(right["q_x"]).astype(np.float64), right["q_row"].to_numpy(), right["q_id"].to_numpy()
                floors = [float("-inf") if f is None else float(f) for f in right["q_floor"].to_pylist()]
                for start in range(0, len(x), QUERY_ROWS):
                    bounds = tree.bounds(x[start:start + QUERY_ROWS])
                    for j, bound in enumerate(bounds, start):
                        got = tree.search(x[j], bound, rows[j], k, floors[j])
                        kth = int(got[-1][0]) if len(got) == k else None
                        for score, i in got:
                            for c, v in zip(names, (rows[j], ids[j], i, int(score), kth)):
                                out[c].append(v)
            return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

        named = asked.select(F.col("shard").alias("q_shard"), F.col("row").alias("q_row"), F.col("vec_id").alias("q_id"),
                             F.col("x").alias("q_x"), F.col("floor").alias("q_floor"))
        return stored.groupBy("shard").cogroup(named.groupBy("q_shard")).applyInArrow(run, schema)

    first = home.withColumn("shard", F.concat_ws(":", width.cast("string"), F.col("home").cast("string"))).withColumn("floor", F.lit(None).cast("long"))
    found = cut(searched(first.drop("home")))
    floors = found.groupBy("row").agg(F.max("kth").alias("floor"))
    others = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("other <> home")
    others = others.withColumn("shard", F.concat_ws(":", width.cast("string"), F.col("other").cast("string"))).drop("home", "other").join(floors, "row", "left")
    best = found.unionByName(searched(others)) if shards > 1 else found
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
