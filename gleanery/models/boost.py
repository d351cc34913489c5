"""Second-order gradient boosting on histograms: trees by level, by best leaf, or symmetric.

Rows are binned once; those that agree in all bins and the label are one row with a weight. A pass sums gradients and Hessians per node, feature and bin where the rows are and adds the sums up
in a tree of tasks; the driver sees sums only. Each pass is a few milliseconds of work per task on small tables, so the
rows stay in an RDD of blocks, which starts a job without a query plan, and are checkpointed every few rounds. The smaller
child of a node is summed, the larger one is the difference. Gradients are rounded to a binary grid on which sums are exact, so
the same trees come from any files.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, shared_folder, spread
from .base import Fitted, merged_chunks, predictor
from .forest import PARTS, TREE, TREE_ARROW, _land, sent_trees, summed_leaves

BLOCK_ROWS, TASK_ROWS, CHECKPOINT_ROUNDS = 65_536, 8192, 10
#: Bytes of binned rows among which a task looks for equal ones, and of packed rows it takes.
CHUNK_BYTES, PACKED_BYTES = 32 << 20, 128 << 20
#: So few rows that differ in bins and label are boosted by one task: its passes take less time than a job for each would.
LOCAL_ROWS = 1 << 19


@dataclass(frozen=True)
class Booster:
    """``shape``: ``level`` splits all nodes down to ``depth``; ``leaf`` splits the best leaf until there are ``leaves``; ``symmetric`` has one split a level."""

    rounds: int
    rate: float
    shape: str = "level"
    depth: int = 6
    leaves: int = 31
    l2: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    bins: int = 256


# ---------------------------------------------------------------- gradients and sums

def _slopes(margin: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by margin, one column per output."""
    if not classes:
        return margin - y[:, None], np.ones_like(margin)
    if classes == 2:
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (np.arange(classes) == y[:, None]), np.maximum(2 * p * (1 - p), 1e-16)


def _margins(block, trees) -> np.ndarray:
    bins, _, margin, _ = block
    if trees:
        margin = margin.copy()
        for c, tree in trees:
            margin[:, c] += tree[4][_land(bins, tree)]
    return margin


def _sums(blocks, growing, wanted, classes: int, width: int, bins: int, grid: float):
    """Sums of (gradient, Hessian, rows) over the blocks of a task, for the wanted nodes of each output's tree. Without weights a block has each row once."""
    first = np.cumsum([0, *[len(w) for w in wanted]])
    total = np.zeros((first[-1] * width * bins, 3))
    for block in blocks:
        g, h = _slopes(block[2], block[1], classes)
        for c, (tree, nodes) in enumerate(zip(growing, wanted)):
            if not len(nodes):
                continue
            at = _land(block[0], tree)
            place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
            hit = np.flatnonzero(nodes[place] == at)
            cell = (((first[c] + place[hit])[:, None] * width + np.arange(width)) * bins + block[0][hit]).ravel()
            times = block[3][hit] if len(block) > 3 else np.ones(len(hit))
            for i, v in enumerate((np.rint(g[hit, c] * grid) * times, np.rint(h[hit, c] * grid) * times, times)):
                total[:, i] += np.bincount(cell, np.repeat(v, width), len(total))
    return total.reshape(-1, width, bins, 3)


class Growing:
    """A tree as it grows: node arrays for landing rows, and for each node its sums and its best split."""

    def __init__(self, how: Booster, cuts: list[np.ndarray], grid: float):
        self.how, self.cuts, self.grid = how, cuts, grid
        self.feature, self.bin, self.left, self.right, self.depth = [-1], [0], [-1], [-1], [0]
        self.stats, self.sums, self.best = [None], {}, {}

    def arrays(self):
        return tuple(np.array(a) for a in (self.feature, self.bin, self.left, self.right))

    def value(self, node: int) -> float:
        g, h, _ = self.stats[node]
        return -g / (h + self.how.l2) * self.how.rate if h + self.how.l2 > 0 else 0.0

    def gains(self, sums: np.ndarray) -> np.ndarray:
        """(feature, cut) gain of a split after each bin; -inf where a child would be too small."""
        left = np.cumsum(sums, axis=1)[:, :-1]
        total = sums[0].sum(axis=0)
        right = total - left
        how, scale = self.how, self.grid
        worth = lambda s: (s[..., 0] / scale) ** 2 / np.maximum(s[..., 1] / scale + how.l2, 1e-300)
        gain = (worth(left) + worth(right) - worth(total)) / 2 - how.least_gain
        fits = np.minimum(left[..., 1], right[..., 1]) >= how.least_hessian * scale
        fits &= np.minimum(left[..., 2], right[..., 2]) >= how.least_rows
        return np.where(fits, gain, -np.inf)

    def fill(self, node: int, sums: np.ndarray) -> None:
        """Keep a node's sums and find its best split; equal gains go to the first feature and cut."""
        self.sums[node] = sums
        total = sums[0].sum(axis=0)
        self.stats[node] = (total[0] / self.grid, total[1] / self.grid, total[2])
        gains = self.gains(sums)
        top = gains.max() if gains.size else -np.inf
        if top > 1e-12:
            f, b = divmod(int(np.argmax(gains >= top * (1 - 1e-9))), gains.shape[1])
            self.best[node] = (float(top), f, b)

    def split(self, node: int, f: int, b: int) -> tuple[int, int]:
        """The two children, the one with fewer rows first; both know their sums' totals."""
        sums = self.sums[node]
        left = sums[f, :b + 1].sum(axis=0)
        right = sums[f].sum(axis=0) - left
        self.feature[node], self.bin[node], self.left[node], self.right[node] = f, b, len(self.feature), len(self.feature) + 1
        for s in (left, right):
            for column, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[node] + 1),
                              (self.stats, (s[0] / self.grid, s[1] / self.grid, s[2]))):
                column.append(v)
        children = (self.left[node], self.right[node])
        return children if left[2] <= right[2] else children[::-1]

    def prune(self, kept: set[int]) -> None:
        """Nodes whose split was tried but not kept are leaves again."""
        for node in range(len(self.feature)):
            if self.feature[node] >= 0 and node not in kept:
                self.feature[node] = self.left[node] = self.right[node] = -1

    def packed(self, outputs: int, output: int) -> dict[str, list]:
        """The nodes that are reached, with real thresholds; values of other outputs are zero."""
        order, place = [0], {0: 0}
        for node in order:
            if self.feature[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    place[child] = len(order)
                    order.append(child)
        value = np.zeros((len(order), outputs))
        value[:, output] = [self.value(n) for n in order]
        gain = np.zeros(len(self.cuts))
        for n in order:
            if self.feature[n] >= 0:
                gain[self.feature[n]] += self.best[n][0] if n in self.best else 0.0
        inner = [self.feature[n] >= 0 for n in order]
        return {"feature": [self.feature[n] for n in order], "threshold": [float(self.cuts[self.feature[n]][self.bin[n]]) if i else 0.0 for n, i in zip(order, inner)],
                "bin": [self.bin[n] for n in order], "left": [place[self.left[n]] if i else -1 for n, i in zip(order, inner)],
                "right": [place[self.right[n]] if i else -1 for n, i in zip(order, inner)], "value": value, "size": [float(self.stats[n][2]) for n in order], "gain": gain.tolist()}


# ---------------------------------------------------------------- shapes of trees

def _by_level(trees: list[Growing], ask, how: Booster) -> None:
    for depth in range(how.depth):
        wanted = []
        for tree in trees:
            pairs = []
            for node in [n for n in range(len(tree.feature)) if tree.depth[n] == depth and n in tree.best and tree.feature[n] < 0]:
                _, f, b = tree.best[node]
                small, large = tree.split(node, f, b)
                pairs.append((node, small, large))
            wanted.append(pairs)
        if depth == how.depth - 1 or not any(wanted):
            return
        ask(wanted)


def _by_leaf(trees: list[Growing], ask, how: Booster) -> None:
    """Best leaf first. All leaves that may still be chosen are split ahead, so a pass serves many of them; what the order did not reach is undone."""
    kept = [set() for _ in trees]
    while True:
        wanted = []
        for i, tree in enumerate(trees):
            kept[i], heap, ahead = set(), [(-tree.best[0][0], 0)] if 0 in tree.best else [], []
            room = how.leaves - 1
            while heap and len(kept[i]) < room:
                gain, node = heapq.heappop(heap)
                if tree.feature[node] < 0:
                    ahead = sorted([(gain, node), *heap])[:room - len(kept[i])]
                    break
                kept[i].add(node)
                for child in (tree.left[node], tree.right[node]):
                    if child in tree.best:
                        heapq.heappush(heap, (-tree.best[child][0], child))
            pairs = []
            for _, node in ahead:
                if tree.feature[node] < 0:
                    small, large = tree.split(node, *tree.best[node][1:])
                    pairs.append((node, small, large))
            wanted.append(pairs)
        if not any(wanted):
            break
        ask(wanted)
    for tree, own in zip(trees, kept):
        tree.prune(own)


def _symmetric(trees: list[Growing], ask, how: Booster) -> None:
    for depth in range(how.depth):
        wanted = []
        for tree in trees:
            nodes = [n for n in range(len(tree.feature)) if tree.depth[n] == depth and tree.feature[n] < 0]
            # A node that cannot be split at a cut gains nothing there and goes whole to one side.
            total = sum(np.maximum(tree.gains(tree.sums[n]), 0.0) for n in nodes) if nodes and all(n in tree.sums for n in nodes) else np.zeros((0, 0))
            pairs = []
            if total.size and total.max() > 1e-12:
                f, b = divmod(int(np.argmax(total >= total.max() * (1 - 1e-9))), total.shape[1])
                for node in nodes:
                    tree.best[node] = (float(max(tree.gains(tree.sums[node])[f, b], 0.0)), f, b)
                    small, large = tree.split(node, f, b)
                    pairs.append((node, small, large))
            wanted.append(pairs)
        if depth == how.depth - 1 or not any(wanted):
            return
        ask(wanted)


SHAPES = {"level": _by_level, "leaf": _by_leaf, "symmetric": _symmetric}


# ---------------------------------------------------------------- training

def cut_points(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Where to cut each feature of ``x``: between all values of a feature with at most ``bins`` of them, else at its quantiles."""
    def run(batches):
        held = [np.empty(0)] * width
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, width)
            # One value too many tells that there are more.
            held = [np.unique(np.append(h, x[:, j]))[:bins + 1] if len(h) <= bins else h for j, h in enumerate(held)]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([h.tolist() for h in held], pa.list_(pa.float64()))], names=["feature", "few"])

    values = rows.select("x").mapInArrow(run, "feature int, few array<double>").select("feature", F.explode("few").alias("v")).distinct()
    few = {r["feature"]: r["v"] for r in values.groupBy("feature").agg(F.slice(F.sort_array(F.collect_list("v")), 1, bins + 1).alias("v")).collect()}
    many = [j for j in range(width) if len(few.get(j, ())) > bins]
    shares = [i / bins for i in range(1, bins)]
    facts = rows.agg(*[F.percentile_approx(F.col("x")[j], shares, 50 * bins).alias(f"q{j}") for j in many]).first() if many else None
    return [np.unique(np.array(facts[f"q{j}"], np.float64)) if j in many else np.convolve(few.get(j, ()), [0.5, 0.5], "valid") if len(few.get(j, ())) > 1 else np.empty(0) for j in range(width)]


def tasks_for(spark: SparkSession, n: int, width: int) -> int:
    """A pass is short: a task with few rows costs more to start than to run."""
    return max(2, min(-(-n // TASK_ROWS), max(spark.sparkContext.defaultParallelism, n * (width + 24) // PACKED_BYTES)))


def _blocks(df: DataFrame, cuts: list[np.ndarray], width: int, tasks: int) -> DataFrame:
    """(bins, y, weight) of up to ``BLOCK_ROWS`` rows each, as bytes. Rows that agree in all bins and the label are one from here on:
    they share every leaf, so their number says all."""
    kind = np.dtype(np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16)

    def binned(batches):
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, width)
            yield np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(kind), batch.column(1).to_numpy()

    def counted(batches):
        for bins, y, n in merged_chunks(binned(batches), max(1, CHUNK_BYTES // (width * kind.itemsize + 16))):
            ends = np.arange(len(y) + 1, dtype=np.int32) * width * kind.itemsize
            rows = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))])
            yield pa.record_batch([rows, pa.array(y), pa.array(n.astype(np.int64))], names=["bins", "y", "n"])

    def packed(batches):
        held, n = [], 0

        def block():
            return pa.record_batch([pa.array([b"".join(part)], pa.binary()) for part in zip(*held)], names=["bins", "y", "n"])

        for batch in batches:
            held.append((b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy().tobytes(), batch.column(2).to_numpy().astype(np.float64).tobytes()))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    rows = df.mapInArrow(counted, "bins binary, y double, n long").repartition(tasks, "bins", "y")
    return cut(rows.groupBy("bins", "y").agg(F.sum("n").alias("n")).mapInArrow(packed, "bins binary, y binary, n binary"))


def _rounds(how: Booster, cuts: list[np.ndarray], grid: float, outputs: int, sums, moved) -> list[dict]:
    """The trees of all rounds. ``sums`` has those of ``_sums`` over all rows for the wanted nodes; ``moved`` adds grown trees to the margins."""
    made = []
    for r in range(how.rounds):
        trees = [Growing(how, cuts, grid) for _ in range(outputs)]

        def ask(pairs):
            """Sum for the smaller child of each pair; the larger one gets the rest."""
            wanted = [np.array(sorted(small for _, small, _ in own), np.int64) for own in pairs]
            total, at = sums([t.arrays() for t in trees], wanted), 0
            for tree, nodes, own in zip(trees, wanted, pairs):
                found = dict(zip(nodes.tolist(), total[at:at + len(nodes)]))
                at += len(nodes)
                for node, small, large in own:
                    tree.fill(small, found[small])
                    if large is not None:
                        tree.fill(large, tree.sums[node] - found[small])
                        del tree.sums[node]

        ask([[(0, 0, None)] for _ in trees])
        SHAPES[how.shape](trees, ask, how)
        grown = []
        for c, tree in enumerate(trees):
            tree = tree.packed(outputs, c)
            made.append(tree)
            grown.append((c, (np.array(tree["feature"]), np.array(tree["bin"]), np.array(tree["left"]), np.array(tree["right"]), tree["value"][:, c])))
        if r < how.rounds - 1:
            moved(grown)
    return made


class _Held:
    """Sums and margins of rows that one task holds. Each node of a growing tree has the list of its rows, which its children divide, so
    a pass reads the rows of the wanted nodes only."""

    def __init__(self, blocks: list, classes: int, width: int, bins: int, grid: float):
        self.x, self.y, self.margin, self.w = (np.concatenate(part) for part in zip(*blocks))
        self.columns, self.classes, self.bins, self.grid = np.ascontiguousarray(self.x.T), classes, bins, grid
        self.start()

    def start(self) -> None:
        g, h = _slopes(self.margin, self.y, self.classes)
        self.slopes = [(np.rint(g[:, c] * self.grid) * self.w, np.rint(h[:, c] * self.grid) * self.w, self.w) for c in range(g.shape[1])]
        self.rows = [{0: np.arange(len(self.y))} for _ in self.slopes]

    def rows_of(self, c: int, node: int, tree) -> np.ndarray:
        feature, cut_bin, left, right = tree
        if node not in self.rows[c]:
            parent = int(np.flatnonzero((left == node) | (right == node))[0])
            rows = self.rows_of(c, parent, tree)
            low = self.columns[feature[parent]].take(rows) <= cut_bin[parent]
            self.rows[c][int(left[parent])], self.rows[c][int(right[parent])] = rows[low], rows[~low]
        return self.rows[c][node]

    def sums(self, growing, wanted) -> np.ndarray:
        out = [np.zeros((0, len(self.columns), self.bins, 3))]
        for c, (tree, nodes) in enumerate(zip(growing, wanted)):
            for node in nodes:
                rows = self.rows_of(c, int(node), tree)
                values = [v.take(rows) for v in self.slopes[c]]
                out.append(np.array([np.stack([np.bincount(column, v, self.bins) for v in values], axis=1) for column in self.columns.take(rows, axis=1)])[None])
        return np.concatenate(out)

    def moved(self, grown) -> None:
        self.margin = _margins((self.x, self.y, self.margin, self.w), grown)
        self.start()


class _Passes:
    """Sums and margins of rows that many tasks hold: a job a pass."""

    def __init__(self, blocks: RDD, *shape):
        self.blocks, self.shape, self.done, self.round = blocks.persist(StorageLevel.MEMORY_AND_DISK), shape, None, 0

    def sums(self, growing, wanted) -> np.ndarray:
        given, shape = self.blocks.context.broadcast((growing, wanted)), self.shape
        sums = self.blocks.mapPartitions(lambda it: [_sums(it, *given.value, *shape)])
        total = sums.reduce(np.add) if self.blocks.getNumPartitions() <= 16 else sums.treeReduce(np.add)
        given.destroy()
        return total

    def moved(self, grown) -> None:
        """Margins move on once a round; the round's first pass writes them, and the round before goes when the next one ends."""
        if self.done is not None:
            self.done.unpersist()
        self.done, self.blocks = self.blocks, self.blocks.map(lambda b: (b[0], b[1], _margins(b, grown), b[3])).persist(StorageLevel.MEMORY_AND_DISK)
        self.round += 1
        if self.round % CHECKPOINT_ROUNDS == 0:
            self.blocks.checkpoint()

    def close(self) -> None:
        for blocks in (self.blocks, self.done):
            if blocks is not None:
                blocks.unpersist()


def fit(df: DataFrame, how: Booster, classes: int, width: int, n: int) -> Fitted:
    """Boost; two classes share one margin, more have one each and meet in a softmax, trained together pass by pass."""
    spark = df.sparkSession
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    tasks = tasks_for(spark, n, width)
    rows = rows.repartition(tasks) if tasks < spark.sparkContext.defaultParallelism else spread(rows)
    shares = [i / how.bins for i in range(1, how.bins)]
    facts = rows.agg(F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"),
                     *[F.percentile_approx(F.col("x")[j], shares, 50 * how.bins).alias(f"q{j}") for j in range(width)]).first()
    cuts = [np.unique(np.array(facts[f"q{j}"] or [], np.float64)) for j in range(width)]
    bins, outputs = max(map(len, cuts), default=0) + 1, classes if classes > 2 else 1
    mean = facts["mean"] or 0.0
    odds = min(max(mean, 1e-6), 1 - 1e-6)
    base = [mean] if not classes else [math.log(odds / (1 - odds))] if classes == 2 else [0.0] * outputs
    reach = 2.0 if classes else max(4 * ((facts["high"] or 0.0) - (facts["low"] or 0.0)), 1.0)
    grid = 2.0 ** (52 - math.ceil(math.log2(max(n, 1) * reach)))
    kind = np.uint8 if bins <= 256 else np.uint16

    def opened(row):
        y = np.frombuffer(row["y"], np.float64)
        return np.frombuffer(row["bins"], kind).reshape(-1, width), y, np.tile(np.array(base), (len(y), 1)), np.frombuffer(row["n"], np.float64)

    packed = _blocks(rows, cuts, width, tasks)
    apart = packed.agg(F.coalesce(F.sum(F.length("y")), F.lit(0)).alias("b")).first()["b"] // 8
    if apart <= min(LOCAL_ROWS, CHUNK_BYTES // (width * np.dtype(kind).itemsize + 16 + 8 * outputs)):
        def whole(batches):
            held = _Held([opened(r) for batch in batches for r in batch.to_pylist()], classes, width, bins, grid)
            made = _rounds(how, cuts, grid, outputs, held.sums, held.moved)
            for i, tree in enumerate(made):
                yield pa.RecordBatch.from_pylist([{"tree": i, **{p: tree[p] if p != "value" else tree[p].ravel().tolist() for p in PARTS}}], TREE_ARROW)

        trees = cut(packed.repartition(1).mapInArrow(whole, f"tree int, {TREE}"))
        return Fitted("boosted", [], {"has_probability": bool(classes), "outputs": outputs, "width": width, "trees": how.rounds * outputs, "base": base, "classes": classes}, {"trees": trees})

    shared_folder(spark)
    passes = _Passes(packed.rdd.map(opened), classes, width, bins, grid)
    made = _rounds(how, cuts, grid, outputs, passes.sums, passes.moved)
    passes.close()
    table = [(i, *[tree[p] if p != "value" else tree[p].ravel().tolist() for p in PARTS]) for i, tree in enumerate(made)]
    return Fitted("boosted", [], {"has_probability": bool(classes), "outputs": outputs, "width": width, "trees": len(made), "base": base, "classes": classes},
                  {"trees": cut(spark.createDataFrame(table, f"tree int, {TREE}"))})


@predictor("boosted")
def _boosted(model: Fitted, df: DataFrame) -> DataFrame:
    """Margins are sums over trees, sent along in groups of bounded size."""
    out = df.withColumn("_x", vector_to_array("features"))
    sums = F.array(*[F.lit(float(b)) for b in model.params["base"]])
    groups = 0
    for group in sent_trees(model):
        out = out.withColumn(f"_s{groups}", summed_leaves(df, group, model.params["width"])("_x"))
        sums = F.zip_with(sums, F.col(f"_s{groups}"), lambda a, b: a + b)
        groups += 1
    out = out.withColumn("_m", sums)
    if not model.has_probability:
        out = out.withColumn("prediction", F.col("_m")[0])
    else:
        if model.params["classes"] == 2:
            p = 1.0 / (1.0 + F.exp(-F.col("_m")[0]))
            out = out.withColumn("probability", F.array(1.0 - p, p))
        else:
            raised = F.transform("_m", lambda v: F.exp(v - F.array_max("_m")))
            out = out.withColumn("_m", raised).withColumn("probability", F.transform("_m", lambda v: v / F.aggregate("_m", F.lit(0.0), lambda a, b: a + b)))
        out = out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
    return out.drop("_x", "_m", *[f"_s{i}" for i in range(groups)])
