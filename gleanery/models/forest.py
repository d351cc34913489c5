"""Forests without a depth limit: histograms for nodes too large for one task, whole subtrees in tasks below.

A tree draws its rows by a hash of row and tree, and the features of a node by a hash of the node's way from the root, so
the same forest comes from any files and any number of tasks. A node that fits a task is split between any two of its values
until it is pure; a larger one is split at quantiles, with one job per level for many trees at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import cut, shuffles_removed
from .base import Fitted, predictor

#: Bytes of feature values that a task holds at once, and of trees that are sent along with a scoring pass.
TASK_BYTES, SENT_BYTES = 32 << 20, 32 << 20
#: Bytes of histograms that a task gathers, which bounds the trees of one job.
HISTOGRAM_BYTES = 64 << 20
#: Bytes of rows dealt to nodes at once, unless the table itself is larger; they bound the trees whose nodes are finished in one job.
DEALT_BYTES = 1 << 30
#: Cells of a table of summed leaf values, and bytes of the ways from ranks into all tables.
TABLE_CELLS, WAYS_BYTES = 1 << 13, 32 << 20
#: Rows that a task takes up together.
CHUNK_ROWS = 262_144
ROOT = 0x9E3779B97F4A7C15
#: Scores, never negative, that differ by less than rounding do are equal.
SAME = 1 - 1e-9
TREE = "feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, size array<double>, gain array<double>"
TREE_ARROW = pa.schema([("tree", pa.int32()), *[(c, pa.list_(pa.int32() if c in ("feature", "left", "right") else pa.float64())) for c in ("feature", "threshold", "left", "right", "value", "size", "gain")]])
PARTS = ["feature", "threshold", "left", "right", "value", "size", "gain"]


@dataclass(frozen=True)
class Plan:
    """``tries`` features that vary are looked at in a node; ``random`` draws one cut for each instead of looking for the best."""

    trees: int
    classes: int
    tries: int
    random: bool = False
    bootstrap: bool = True
    seed: int = 42

    @property
    def outputs(self) -> int:
        return max(1, self.classes)


def mixed(x):
    """A hash of 64-bit numbers to 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def root_path(plan: Plan, tree: int) -> np.uint64:
    return np.uint64(mixed(np.uint64((ROOT + plan.seed * 1_000_003 + tree) & (2**64 - 1))))


def child_path(path, side):
    with np.errstate(over="ignore"):
        return mixed(np.asarray(path, np.uint64) * np.uint64(2) + np.asarray(side).astype(np.uint64) + np.uint64(ROOT))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
#: The draw at every 65536th of the unit interval; between two of them that agree nothing has to be searched.
_DRAWN = np.searchsorted(_POISSON, np.arange(65_537) / 65_536, "right")


def draws(key: np.ndarray, plan: Plan, tree: int) -> np.ndarray:
    """How often a tree draws each row: a Poisson number with mean one, or one."""
    if not plan.bootstrap:
        return np.ones(len(key))
    hashed = mixed(key.view(np.uint64) ^ root_path(plan, tree))
    part = (hashed >> np.uint64(48)).astype(np.int64)
    out = _DRAWN[part]
    open_ = np.flatnonzero(_DRAWN[part + 1] != out)
    out[open_] = np.searchsorted(_POISSON, _unit(hashed[open_]), "right")
    return out.astype(np.float64)


def _ranks(paths: np.ndarray, width: int) -> np.ndarray:
    """(node, feature): the order in which a node looks at features."""
    with np.errstate(over="ignore"):
        return mixed(paths[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _looked_at(varying: np.ndarray, ranks: np.ndarray, tries: int) -> np.ndarray:
    """The first ``tries`` features of each node among those that vary in it."""
    if tries >= varying.shape[1]:
        return varying
    held = np.where(varying, ranks, np.uint64(2**64 - 1))
    return varying & (held <= np.partition(held, tries - 1, axis=1)[:, tries - 1:tries])


def _cut_between(low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A number drawn from [low, high)."""
    drawn = low + _unit(mixed(ranks)) * (high - low)
    return np.where(drawn >= high, low, drawn)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: Plan, path) -> dict[str, np.ndarray]:
    """The whole tree below a node, level by level, for weighted rows: nodes as arrays, children by position, -1 for none.

    Gini impurity or variance; a node is split as long as it is not pure and some feature varies. ``gain`` has one entry
    per feature, the summed loss of impurity times weight.
    """
    held = w > 0
    x, y, w = x[held], y[held], w[held]
    n, width = x.shape
    a = np.zeros((n, plan.outputs))
    if plan.classes:
        a[np.arange(n), y.astype(np.int64)] = w
    out = {"feature": [np.array([-1])], "threshold": [np.zeros(1)], "left": [np.array([-1])], "right": [np.array([-1])],
           "value": [np.zeros((1, plan.outputs))], "size": [np.zeros(1)]}
    gain = np.zeros(width)
    if not n:
        return {k: np.concatenate(v) for k, v in out.items()} | {"gain": gain}
    out = {k: [] for k in out}
    orders = [np.argsort(x[:, j], kind="stable") for j in range(width)]
    counts, paths, made = np.array([n]), np.array([path], np.uint64), 1
    while len(counts):
        m, ends = len(counts), np.cumsum(counts)
        starts = ends - counts
        first = orders[0]
        weight, spread = np.add.reduceat(w[first], starts), np.maximum.reduceat(y[first], starts) > np.minimum.reduceat(y[first], starts)
        if plan.classes:
            total = np.add.reduceat(a[first], starts)
            value = total / weight[:, None]
        else:
            # Numbers count from their node's mean, so that small differences far down are not lost.
            value = np.where(spread, np.add.reduceat((w * y)[first], starts) / weight, y[first[starts]])[:, None]
            a[first, 0] = w[first] * (y[first] - np.repeat(value[:, 0], counts))
            total = np.zeros((m, 1))
        worth = (total * total).sum(axis=1) / weight
        low = np.stack([x[o[starts], j] for j, o in enumerate(orders)], axis=1)
        high = np.stack([x[o[ends - 1], j] for j, o in enumerate(orders)], axis=1)
        ranks = _ranks(paths, width)
        looked = _looked_at((high > low) & spread[:, None], ranks, plan.tries)
        scores, places = np.full((m, width), -np.inf), np.zeros((m, width))
        for j in range(width):
            nodes = np.flatnonzero(looked[:, j])
            if not len(nodes):
                continue
            rows = orders[j] if len(nodes) == m else orders[j][np.repeat(looked[:, j], counts)]
            size = counts[nodes]
            begin, v, owner = np.cumsum(size) - size, x[rows, j], np.repeat(np.arange(len(nodes)), size)
            if plan.random:
                drawn = _cut_between(low[nodes, j], high[nodes, j], ranks[nodes, j])
                under = (v <= drawn[owner])[:, None]
                left, left_w = np.add.reduceat(a[rows] * under, begin), np.add.reduceat(w[rows] * under[:, 0], begin)
                place, where = drawn, np.arange(len(nodes))
            else:
                sums, weights = np.cumsum(a[rows], axis=0), np.cumsum(w[rows])
                edge = np.flatnonzero((v[1:] > v[:-1]) & (owner[1:] == owner[:-1]))
                where = owner[edge]
                left = sums[edge] - (sums[begin] - a[rows[begin]])[where]
                left_w = weights[edge] - (weights[begin] - w[rows[begin]])[where]
                middle = (v[edge] + v[edge + 1]) / 2
                place = np.where((middle >= v[edge + 1]) | ~np.isfinite(middle), v[edge], middle)
            right, right_w = total[nodes[where]] - left, weight[nodes[where]] - left_w
            score = (left * left).sum(axis=1) / left_w + (right * right).sum(axis=1) / right_w
            if not plan.random:
                change = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
                top = np.maximum.reduceat(score, change)
                hit = np.flatnonzero(score >= np.repeat(top, np.diff(np.append(change, len(score)))) * SAME)
                hit = hit[np.concatenate([[True], np.diff(where[hit]) != 0])]
                score, place = top, place[hit]
            scores[nodes, j], places[nodes, j] = score, place
        best = scores.max(axis=1)
        split = best > -np.inf
        # Equal scores go to the feature that the node looks at first.
        at = np.where(split, np.where(scores >= best[:, None] * SAME, ranks, np.uint64(2**64 - 1)).argmin(axis=1), -1)
        threshold = places[np.arange(m), np.maximum(at, 0)]
        born = np.cumsum(split) - 1
        for name, values in (("feature", at), ("threshold", threshold), ("left", np.where(split, made + 2 * born, -1)), ("right", np.where(split, made + 2 * born + 1, -1)),
                             ("value", value), ("size", weight)):
            out[name].append(values)
        np.add.at(gain, at[split], (best - worth)[split])
        made += 2 * int(split.sum())
        # Rows go to the two children of their node, in the order that each feature has them.
        side = np.zeros(n, bool)
        owner = np.repeat(np.arange(m), counts)
        side[first] = x[first, np.maximum(at, 0)[owner]] > threshold[owner]
        going, right = split[owner], side[first]
        sizes = np.stack([np.bincount(owner[~right], minlength=m), np.bincount(owner[right], minlength=m)], axis=1)[split]
        offset = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 2)
        for j, order in enumerate(orders):
            right = side[order]
            seen = np.cumsum(right)
            rank_right = seen - 1 - (seen[starts] - right[starts])[owner]
            rank = np.where(right, rank_right, np.arange(len(order)) - starts[owner] - rank_right - 1)
            to = offset[born[owner[going]], right[going].astype(int)] + rank[going]
            moved = np.empty(len(to), order.dtype)
            moved[to] = order[going]
            orders[j] = moved
        counts = sizes.ravel()
        paths = np.stack([child_path(paths[split], 0), child_path(paths[split], 1)], axis=1).ravel()
    return {k: np.concatenate(v) for k, v in out.items()} | {"gain": gain}


def _table_schema(*keys: str) -> pa.Schema:
    kinds = {"feature": pa.int32(), "left": pa.int32(), "right": pa.int32()}
    return pa.schema([*[(k, pa.int32()) for k in keys], *[(p, pa.list_(kinds.get(p, pa.float64()))) for p in PARTS]])


def _batch(keys: dict[str, int], tree: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One tree as a row; its arrays are not taken apart into numbers."""
    schema = _table_schema(*keys)
    lists = [pa.ListArray.from_arrays(pa.array([0, tree[p].size], pa.int32()), pa.array(tree[p].ravel(), schema.field(p).type.value_type)) for p in PARTS]
    return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in keys.values()], *lists], schema=schema)


def _lists(data: pa.Table, names: list[str]) -> list[dict[str, np.ndarray]]:
    columns = {p: data.column(p).combine_chunks() for p in names}
    return [{p: columns[p][i].values.to_numpy(zero_copy_only=False) for p in names} for i in range(data.num_rows)]


# ---------------------------------------------------------------- training

def _matrix(data: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    column = data.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _in_order(key, x, y):
    """Rows in an order of their own, so that sums do not depend on files."""
    order = np.lexsort((*x.T[::-1], y, key))
    return key[order], x[order], y[order]


def _small(rows: DataFrame, plan: Plan, width: int) -> DataFrame:
    """All rows fit a task: they are sent to all tasks, which grow whole trees."""
    data = rows.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(_in_order(data["key"].to_numpy(), _matrix(data, width), data["y"].to_numpy()))

    def run(batches):
        key, x, y = shared.value
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                grown = grow(x, y, draws(key, plan, tree), plan, root_path(plan, tree))
                yield _batch({"tree": tree}, grown)

    numbers = rows.sparkSession.range(plan.trees, numPartitions=min(plan.trees, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return numbers.select(F.col("id").cast("int").alias("tree")).mapInArrow(run, f"tree int, {TREE}")


class Top:
    """The upper part of a tree as it grows: nodes as lists. A node is ``big`` (split next), ``pending`` (for a task), ``pure`` or split."""

    def __init__(self, path: int):
        self.feature, self.threshold, self.left, self.right, self.path = [-1], [0.0], [-1], [-1], [int(path)]
        self.state, self.value, self.size = ["big"], [None], [0.0]

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.threshold, self.left, self.right))

    def split(self, node: int, feature: int, threshold: float, sides: list[tuple[float, str, list[float] | None]]) -> None:
        self.feature[node], self.threshold[node], self.state[node] = feature, threshold, "split"
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for side, (size, state, value) in enumerate(sides):
            for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.path, int(child_path(np.uint64(self.path[node]), side))),
                              (self.state, state), (self.value, value), (self.size, size)):
                column.append(v)


def _land(x: np.ndarray, arrays) -> np.ndarray:
    """The node at which each row arrives."""
    feature, threshold, left, right = arrays[:4]
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x) if feature[0] >= 0 else 0)
    flat, width, node = x.ravel(), x.shape[1], at
    while len(going):
        node = np.where(flat[going * width + feature[node]] <= threshold[node], left[node], right[node])
        at[going] = node
        inner = feature[node] >= 0
        going, node = going[inner], node[inner]
    return at


def _chunks(batches, width: int):
    """(x, y, weights of a tree) for many rows at a time. Rows that are equal but for their key are landed and counted once."""
    held, n = [], 0

    def chunk():
        key, x, y = (np.concatenate(part) for part in zip(*held))
        order = np.lexsort((y, *x.T))
        new = np.ones(len(y), bool)
        new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1) | (y[order[1:]] != y[order[:-1]])
        owner = np.empty(len(y), np.int64)
        owner[order] = np.cumsum(new) - 1
        first = order[new]
        return x[first], y[first], lambda plan, tree: np.bincount(owner, draws(key, plan, tree), len(first))

    for batch in batches:
        held.append((batch.column("key").to_numpy(), _matrix(batch, width), batch.column("y").to_numpy()))
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield chunk()
            held, n = [], 0
    if n:
        yield chunk()


def _level(rows: DataFrame, tops: dict[int, Top], big: dict[int, list[int]], cuts: list[np.ndarray], plan: Plan) -> list:
    """For every big node and feature its best cut: (tree, node, feature, varies, score, cut, worth, left weight, right weight, weights by class of both)."""
    width, bins = len(cuts), max(len(c) for c in cuts) + 1
    shared = rows.sparkSession.sparkContext.broadcast(({t: (tops[t].arrays(), np.array(n), np.array([tops[t].path[i] for i in n], np.uint64)) for t, n in big.items()}, cuts))
    k = plan.outputs + (0 if plan.classes else 1)

    def count(batches):
        trees, cuts = shared.value
        held = {t: np.zeros((len(nodes), width, bins, k)) for t, (_, nodes, _) in trees.items()}
        for x, y, weights in _chunks(batches, width):
            bin_of = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
            for t, (arrays, nodes, _) in trees.items():
                w = weights(plan, t)
                at = _land(x, arrays)
                place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                hit = np.flatnonzero((nodes[place] == at) & (w > 0))
                first, w, label, size = place[hit] * bins, w[hit], y[hit], len(nodes) * bins
                for j in range(width):
                    cell = first + bin_of[hit, j]
                    if plan.classes:
                        held[t][:, j] += np.bincount(cell * k + label.astype(np.int64), w, size * k).reshape(-1, bins, k)
                    else:
                        held[t][:, j, :, 0] += np.bincount(cell, w * label, size).reshape(-1, bins)
                        held[t][:, j, :, 1] += np.bincount(cell, w, size).reshape(-1, bins)
        for t, sums in held.items():
            nodes = trees[t][1]
            yield pa.record_batch([pa.array(np.full(sums.shape[0] * width, t), pa.int32()), pa.array(np.repeat(nodes, width), pa.int32()), pa.array(np.tile(np.arange(width), len(nodes)), pa.int32()),
                                   pa.array([s.tobytes() for s in sums.reshape(-1, bins * k)], pa.binary())], names=["tree", "node", "feature", "sums"])

    out = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("varies", pa.bool_()), *[(c, pa.float64()) for c in ("score", "cut", "worth", "left", "right")],
                     ("left_classes", pa.list_(pa.float64())), ("right_classes", pa.list_(pa.float64()))])

    def best(key, data):
        trees, cuts = shared.value
        tree, node, feature = (v.as_py() for v in key)
        sums = np.sort(np.stack([np.frombuffer(b.as_buffer(), np.float64) for b in data["sums"]]), axis=0).sum(axis=0).reshape(bins, k)
        weight = sums.sum(axis=1) if plan.classes else sums[:, 1]
        full, all_weight = np.flatnonzero(weight), weight.sum()
        stats = sums if plan.classes else sums[:, :1] - weight[:, None] * (sums[:, 0].sum() / all_weight if all_weight else 0.0)
        total = stats.sum(axis=0)
        worth = float((total * total).sum() / all_weight) if all_weight else 0.0
        if len(full) < 2:
            return pa.Table.from_pylist([{"tree": tree, "node": node, "feature": feature, "varies": False}], out)
        left, left_w = np.cumsum(stats, axis=0), np.cumsum(weight)
        options = full[:-1]
        if plan.random:
            _, nodes, paths = trees[tree]
            rank = _ranks(paths[nodes == node], width)[0, feature]
            edge = cuts[feature]
            drawn = _cut_between(edge[full[0]], edge[min(full[-1], len(edge) - 1)], rank)
            options = options[[max(0, int(np.searchsorted(edge[options], drawn, "right")) - 1)]]
        right, right_w = total - left[options], all_weight - left_w[options]
        score = (left[options] ** 2).sum(axis=1) / left_w[options] + (right**2).sum(axis=1) / right_w
        i = int(np.argmax(score >= score.max() * SAME))
        b = options[i]
        return pa.Table.from_pylist([{"tree": tree, "node": node, "feature": feature, "varies": True, "score": float(score[i]), "cut": float(cuts[feature][b]),
                                      "worth": worth, "left": float(left_w[b]), "right": float(right_w[i]),
                                      "left_classes": left[b].tolist() if plan.classes else [], "right_classes": right[i].tolist() if plan.classes else []}], out)

    counted = rows.mapInArrow(count, "tree int, node int, feature int, sums binary")
    schema = "tree int, node int, feature int, varies boolean, score double, cut double, worth double, left double, right double, left_classes array<double>, right_classes array<double>"
    return counted.groupBy("tree", "node", "feature").applyInArrow(best, schema).collect()


def _cut_points(rows: DataFrame, width: int, n: int, limit: int) -> list[np.ndarray]:
    """Quantiles of every feature, so many that values that differ do not stay together in more rows than a task holds."""
    bins = int(min(65_535, max(255, 4 * n // limit)))
    shares = [i / bins for i in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(F.col("x")[j], shares, 20 * bins).alias(f"q{j}") for j in range(width)]).first()
    return [np.unique(np.array(row[f"q{j}"] or [], np.float64)) for j in range(width)]


def _is_pure(by_class: list[float]) -> bool:
    return sum(v > 0 for v in by_class) == 1


def _shares(by_class: list[float]) -> list[float]:
    return [v / sum(by_class) for v in by_class]


def _large(rows: DataFrame, plan: Plan, width: int, n: int, limit: int, dealt_bytes: int) -> DataFrame:
    """More rows than a task holds: big nodes level by level from sums, then every impure node that fits in a task of its own."""
    rows = cut(rows)
    cuts = _cut_points(rows, width, n, limit)
    node_bytes = width * (max(len(c) for c in cuts) + 1) * (plan.outputs + 1) * 8
    tops, gains = {t: Top(root_path(plan, t)) for t in range(plan.trees)}, np.zeros((plan.trees, width))
    while True:
        big = {t: [i for i, s in enumerate(top.state) if s == "big"] for t, top in tops.items()}
        big = {t: nodes for t, nodes in big.items() if nodes}
        if not big:
            break
        wave, held = {}, 0
        for t, nodes in big.items():
            if not wave or held + len(nodes) * node_bytes <= HISTOGRAM_BYTES:
                wave[t], held = nodes, held + len(nodes) * node_bytes
        found: dict[tuple[int, int], list] = {}
        for r in _level(rows, tops, wave, cuts, plan):
            found.setdefault((r["tree"], r["node"]), []).append(r)
        for (t, node), options in sorted(found.items()):
            top = tops[t]
            options.sort(key=lambda r: r["feature"])
            ranks = _ranks(np.array([top.path[node]], np.uint64), width)
            looked = _looked_at(np.array([[r["varies"] for r in options]]), ranks, plan.tries)[0]
            open_ = [r for r in options if looked[r["feature"]]]
            if not open_:
                top.state[node] = "pending"
                continue
            by_class = [a + b for a, b in zip(open_[0]["left_classes"], open_[0]["right_classes"])]
            if _is_pure(by_class):
                top.state[node], top.value[node], top.size[node] = "pure", _shares(by_class), sum(by_class)
                continue
            top_score = max(r["score"] for r in open_) * SAME
            r = min((r for r in open_ if r["score"] >= top_score), key=lambda r: int(ranks[0, r["feature"]]))
            gains[t, r["feature"]] += r["score"] - r["worth"]
            top.split(node, r["feature"], r["cut"], [
                (r[side], "pure", _shares(r[f"{side}_classes"])) if _is_pure(r[f"{side}_classes"]) else (r[side], "big" if r[side] > limit else "pending", None)
                for side in ("left", "right")])
    # Nodes are finished for so many trees at a time that the rows on their way stay in proportion to the table.
    row_bytes = 8 * width + (6 if plan.classes else 12)
    room, waves, held = max(dealt_bytes, 4 * n * row_bytes), [[]], 0
    for t, top in tops.items():
        # A root that does not vary has no size yet.
        size = row_bytes * sum(top.size[i] or n for i, s in enumerate(top.state) if s == "pending")
        if waves[-1] and held + size > room:
            waves.append([])
            held = 0
        waves[-1].append(t)
        held += size
    out = None
    for wave in waves:
        done = cut(_finished(rows, {t: tops[t] for t in wave}, gains, plan, width))
        out = done if out is None else out.unionByName(done)
    return out


def _finished(rows: DataFrame, tops: dict[int, Top], gains: np.ndarray, plan: Plan, width: int) -> DataFrame:
    """The rows of all pending nodes go to their nodes as packed blocks, whose subtrees are grown and hung below the tops."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(({t: (top.arrays(), np.array([s == "pending" for s in top.state]), np.array(top.path, np.uint64), top.value, top.size) for t, top in tops.items()}, gains))
    label = np.dtype(np.uint16 if plan.classes else np.float64)
    kind = np.dtype([*[(f"x{j}", np.float64) for j in range(width)], ("y", label), ("w", np.uint32)])

    def dealt(batches):
        trees, _ = shared.value
        for x, y, weights in _chunks(batches, width):
            for t, (arrays, pending, *_) in trees.items():
                if not pending.any():
                    continue
                at = _land(x, arrays)
                w = weights(plan, t)
                hit = np.flatnonzero((w > 0) & pending[at])
                hit = hit[np.argsort(at[hit], kind="stable")]
                nodes, begin = np.unique(at[hit], return_index=True)
                blocks = []
                for part in np.split(hit, begin[1:]) if len(nodes) else []:
                    # Column by column, which packs better.
                    blocks.append(b"".join([*[x[part, j].tobytes() for j in range(width)], y[part].astype(label).tobytes(), w[part].astype(np.uint32).tobytes()]))
                yield pa.record_batch([pa.array(np.full(len(nodes), t), pa.int32()), pa.array(nodes, pa.int32()), pa.array(blocks, pa.binary())], names=["tree", "node", "block"])

    def opened(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(block) // kind.itemsize
        x = np.frombuffer(block, np.float64, n * width).reshape(width, n).T
        y = np.frombuffer(block, label, n, 8 * n * width)
        return x, y.astype(np.float64), np.frombuffer(block, np.uint32, n, n * (8 * width + label.itemsize)).astype(np.float64)

    def finish(key, data):
        trees, _ = shared.value
        tree, node = (v.as_py() for v in key)
        x, y, w = (np.concatenate(part) for part in zip(*[opened(b.as_buffer().to_pybytes()) for b in data["block"]]))
        if not plan.classes:
            # Sums of numbers depend on their order, and on equal rows of several blocks being one; those of class weights are exact.
            by = np.lexsort((*x.T[::-1], y))
            x, y, w = x[by], y[by], w[by]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])]))
            x, y, w = x[first], y[first], np.add.reduceat(w, first)
        grown = grow(x, y, w, plan, trees[tree][2][node])
        return pa.Table.from_batches([_batch({"tree": tree, "node": node}, grown)])

    def joined(key, data):
        trees, gains = shared.value
        tree = key[0].as_py()
        (feature, threshold, left, right), _, _, value, size = trees[tree]
        top = {"feature": feature, "threshold": threshold, "left": left, "right": right, "value": np.array([v or [0.0] * plan.outputs for v in value]), "size": np.array(size, np.float64)}
        out, made, gain = {k: [v.copy()] for k, v in top.items()}, len(feature), gains[tree].copy()
        below = {node: sub for node, sub in zip(data["node"].to_pylist(), _lists(data, PARTS)) if node >= 0}
        for node in sorted(below):
            sub = below[node]
            sub["value"] = sub["value"].reshape(-1, plan.outputs)
            for name in out:
                shifted = np.where(sub[name] >= 0, sub[name] + made - 1, -1) if name in ("left", "right") else sub[name]
                out[name][0][node] = shifted[0]
                out[name].append(shifted[1:])
            made += len(sub["feature"]) - 1
            gain += sub["gain"]
        # Children of the top come after their parents.
        value, size = out["value"][0], out["size"][0]
        for node in range(len(feature) - 1, -1, -1):
            if feature[node] >= 0:
                a, b = left[node], right[node]
                size[node] = size[a] + size[b]
                value[node] = (value[a] * size[a] + value[b] * size[b]) / size[node]
        return pa.Table.from_batches([_batch({"tree": tree}, {k: np.concatenate(v) for k, v in out.items()} | {"gain": gain})])

    blocks = rows.mapInArrow(dealt, "tree int, node int, block binary")
    parts = cut(blocks.groupBy("tree", "node").applyInArrow(finish, f"tree int, node int, {TREE}"))
    # A tree whose top is all there is has no parts.
    every = spark.createDataFrame([(t, -1, *[[] for _ in PARTS]) for t in tops], parts.schema)
    return parts.unionByName(every).groupBy("tree").applyInArrow(joined, f"tree int, {TREE}")


def fit(df: DataFrame, plan: Plan, width: int, n: int, kind: str = "grown", task_bytes: int = TASK_BYTES, dealt_bytes: int = DEALT_BYTES) -> Fitted:
    """Grow the forest and write its trees. Missing values and labels do not occur in training frames."""
    name = F.col("row_id").cast("string") if "row_id" in df.columns else F.lit("")
    rows = df.select(F.xxhash64(name, F.col("label")).alias("key"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    limit = max(1, task_bytes // (8 * (width + 3)))
    if n <= limit:
        trees = _small(rows, plan, width)
    else:
        with shuffles_removed(df.sparkSession):
            trees = _large(rows, plan, width, n, limit, dealt_bytes)
    return Fitted(kind, [], {"has_probability": bool(plan.classes), "outputs": plan.outputs, "width": width, "trees": plan.trees}, {"trees": cut(trees)})


# ---------------------------------------------------------------- scoring

def sent_trees(model: Fitted, limit: int = SENT_BYTES):
    """The trees in groups of bounded size, each as lists of arrays; one group is held by the driver at a time."""
    sizes = model.tables["trees"].select("tree", F.size("feature").alias("n")).orderBy("tree").collect()
    groups, held = [[]], 0
    for r in sizes:
        bytes_ = r["n"] * (32 + 8 * model.params["outputs"])
        if groups[-1] and held + bytes_ > limit:
            groups.append([])
            held = 0
        groups[-1].append(r["tree"])
        held += bytes_
    for group in groups:
        rows = model.tables["trees"].filter(F.col("tree").between(group[0], group[-1])).orderBy("tree").select(*PARTS).toArrow()
        yield [(r["feature"], r["threshold"], r["left"], r["right"], r["value"].reshape(-1, model.params["outputs"]), r["size"]) for r in _lists(rows, PARTS)]


def tabled(trees: list) -> tuple[dict, list, list]:
    """Trees as tables of their summed leaf values: (cuts by feature, tables, trees that stay as they are).

    The cuts of a few trees divide the features into cells, and all rows of a cell reach the same leaves. Trees are taken
    together while their cells stay below ``TABLE_CELLS``; a tree with more of them is walked. A row's place among
    the cuts of all tables is looked up once, and each table has its ways from there to the row's cell.
    """
    def cells(cuts):
        return math.prod(len(c) + 1 for c in cuts.values())

    groups, rest = [], []
    for tree in trees:
        own = {int(j): np.unique(tree[1][tree[0] == j]) for j in np.unique(tree[0]) if j >= 0}
        if cells(own) > TABLE_CELLS:
            rest.append(tree)
            continue
        both = {j: np.union1d(groups[-1][0].get(j, ()), own.get(j, ())) for j in groups[-1][0].keys() | own.keys()} if groups else {}
        if groups and cells(both) <= TABLE_CELLS:
            groups[-1] = (both, [*groups[-1][1], tree])
        else:
            groups.append((own, [tree]))
    every = {j: np.unique(np.concatenate([cuts[j] for cuts, _ in groups if j in cuts])) for j in sorted({j for cuts, _ in groups for j in cuts})}
    if len(groups) * sum(len(c) + 1 for c in every.values()) * 8 > WAYS_BYTES:
        return {}, [], trees
    tables = []
    for cuts, members in groups:
        n, step, ways, x = cells(cuts), 1, {}, np.zeros((cells(cuts), max(cuts, default=0) + 1))
        for j, own in cuts.items():
            ways[j] = np.concatenate([[0], np.cumsum(np.isin(every[j], own))]) * step
            x[:, j] = np.append(own, np.inf)[np.arange(n) // step % (len(own) + 1)]
            step *= len(own) + 1
        tables.append((ways, np.ascontiguousarray(sum(tree[4][_land(x, tree)] for tree in members).T)))
    return every, tables, rest


def leaf_sums(x: np.ndarray, shared: tuple[dict, list, list]) -> np.ndarray:
    """(row, output): the leaf values of each row, summed over what ``tabled`` made of the trees."""
    cuts, tables, rest = shared
    total = np.zeros(((tables[0][1].shape[0] if tables else rest[0][4].shape[1]), len(x)))
    places = {j: np.searchsorted(c, x[:, j], "left") for j, c in cuts.items()}
    for ways, table in tables:
        cell = np.zeros(len(x), np.int64)
        for j, way in ways.items():
            cell += way.take(places[j])
        total += table.take(cell, axis=1)
    for tree in rest:
        total += tree[4][_land(x, tree)].T
    return total.T


def summed_leaves(df: DataFrame, trees: list, width: int):
    """A function from an array column of features to that of ``leaf_sums``."""
    shared = df.sparkSession.sparkContext.broadcast(tabled(trees))

    @F.arrow_udf("array<double>")
    def summed(xs: pa.Array) -> pa.Array:
        sums = leaf_sums(np.asarray(xs.flatten()).reshape(-1, width), shared.value)
        return pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1], np.ascontiguousarray(sums).ravel())

    return summed


@predictor("grown")
def _grown(model: Fitted, df: DataFrame) -> DataFrame:
    """The mean of the trees' leaf values, trees sent along in groups of bounded size."""
    count, sums = model.params["trees"], None
    out = df.withColumn("_x", vector_to_array("features"))
    for i, group in enumerate(sent_trees(model)):
        out = out.withColumn(f"_s{i}", summed_leaves(df, group, model.params["width"])("_x"))
        sums = F.col("_s0") if sums is None else F.zip_with(sums, F.col(f"_s{i}"), lambda a, b: a + b)
    out = out.withColumn("_mean", F.transform(sums, lambda v: v / count))
    if model.has_probability:
        out = out.withColumn("probability", F.col("_mean")).withColumn("prediction", (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double"))
    else:
        out = out.withColumn("prediction", F.col("_mean")[0])
    return out.drop("_x", "_mean", *[c for c in out.columns if c.startswith("_s") and c[2:].isdigit()])


def importances(model: Fitted) -> list[float]:
    """Share of each feature in the loss of impurity, averaged over trees."""
    total = F.aggregate("gain", F.lit(0.0), lambda a, b: a + b)
    share = F.transform("gain", lambda g: F.when(total > 0, g / total).otherwise(0.0))
    row = model.tables["trees"].select(share.alias("g")).agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(model.params["width"])]).first()
    sums = [max(0.0, float(v or 0.0)) for v in row]
    return [v / sum(sums) if sum(sums) else 0.0 for v in sums]
