"""Multilayer perceptrons, every step on all rows: rows are scaled and packed into blocks a single time, tasks sum gradients over
their blocks, the driver takes the step.

The blocks stay in an RDD, as those of the boosters do: a step is one short job without a query plan, and only a vector as long as
the weights moves per task. Blocks hold single precision; sums over blocks are double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from .base import Context, Fitted, merged_chunks, predictor

#: Rows of a block, and values of a block at most.
ROWS, VALUES = 1024, 1 << 20
#: Values that a packing task holds while it looks for equal rows.
HELD_VALUES = 1 << 21


def _scaling(df: DataFrame) -> tuple[list[float], list[float]]:
    s = df.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    n = max(1, s["count"])
    std = np.sqrt(s["variance"].toArray() * (n - 1) / n)
    return s["mean"].toArray().tolist(), np.where(std > 0, std, 1.0).tolist()


def _matrix(column: pa.Array, mean: np.ndarray, std: np.ndarray, kind: type) -> np.ndarray:
    return ((column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) / std).astype(kind)


def row_blocks(df: DataFrame, target: Column, mean: list[float], std: list[float], kind: type = np.float32) -> RDD:
    """(scaled features, target) matrices of at most ``ROWS`` rows."""
    mean, std = np.array(mean), np.array(std)
    rows = max(1, min(ROWS, VALUES // max(1, len(mean))))

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column(0), mean, std, kind), batch.column(1).to_numpy(zero_copy_only=False)
            starts = range(0, len(y), rows)
            if len(y):
                yield pa.record_batch([pa.array([x[i:i + rows].tobytes() for i in starts], pa.binary()), pa.array([y[i:i + rows].tobytes() for i in starts], pa.binary())], names=["x", "y"])

    packed = df.select(vector_to_array("features").alias("x"), target.cast("double").alias("y")).mapInArrow(run, "x binary, y binary")
    width = len(mean)
    opened = lambda r: (np.frombuffer(bytes(r["x"]), kind).reshape(-1, width), np.frombuffer(bytes(r["y"])))
    return packed.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)


def weighted_blocks(df: DataFrame, target: Column, mean: list[float], std: list[float], kind: type = np.float32) -> RDD:
    """(scaled features, target, weights) of at most ``ROWS`` rows; a task packs equal rows once, with their number as weight.

    A task whose first rows differ for the most part packs its rows as they come. Where all weights are one there are none.
    """
    mean, std = np.array(mean), np.array(std)
    rows, room = max(1, min(ROWS, VALUES // max(1, len(mean)))), max(1, HELD_VALUES // (len(mean) + 2))

    def packed(x, y, w):
        arrays, starts = (x, y, w.astype(kind)), range(0, len(y), rows)
        if (w == 1).all():
            arrays = (x, y, w[:0])
        return pa.record_batch([pa.array([a[i:i + rows].tobytes() for i in starts], pa.binary()) for a in arrays], names=["x", "y", "w"])

    def run(batches):
        chunks = ((_matrix(b.column(0), mean, std, kind), b.column(1).to_numpy(zero_copy_only=False).astype(kind)) for b in batches)
        for chunk in merged_chunks(chunks, room):
            yield packed(*chunk)

    blocks = df.select(vector_to_array("features").alias("x"), target.cast("double").alias("y")).mapInArrow(run, "x binary, y binary, w binary")
    width = len(mean)
    opened = lambda r: (np.frombuffer(bytes(r["x"]), kind).reshape(-1, width), np.frombuffer(bytes(r["y"]), kind), np.frombuffer(bytes(r["w"]), kind) if r["w"] else None)
    return blocks.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)


def _shapes(layers: list[int]):
    return [(a, b) for a, b in zip(layers, layers[1:])]


def _unpack(flat: np.ndarray, layers: list[int]):
    out, at = [], 0
    for a, b in _shapes(layers):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _rectified(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _forward(x: np.ndarray, weights, classes: bool) -> list[np.ndarray]:
    """Activations of every layer; sigmoid (classes) or rectified inside, linear at the end."""
    acts, inside = [x], _sigmoid if classes else _rectified
    for i, (w, b) in enumerate(weights):
        z = acts[-1] @ w + b
        acts.append(z if i == len(weights) - 1 else inside(z))
    return acts


def _gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: list[int], classes: bool, w: np.ndarray | None = None) -> np.ndarray:
    """Sum over the rows of the loss (cross-entropy, or half the squared error), and of its gradient; ``w`` has the weights of the rows.

    Arrays as long as the block are written over where they are not needed any more, and small ones are summed along their long side.
    """
    weights = _unpack(flat, layers)
    w, acts = np.ones(len(y), x.dtype) if w is None else w.astype(x.dtype), [x]
    for i, (m, b) in enumerate(weights):
        z = acts[-1] @ m
        z += b
        if i < len(weights) - 1 and classes:
            with np.errstate(over="ignore"):
                np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
        elif i < len(weights) - 1:
            np.maximum(z, 0.0, out=z)
        acts.append(z)
    if classes:
        share, at = np.ascontiguousarray(acts[-1].T), (y.astype(int), np.arange(len(y)))
        share -= share.max(axis=0)
        np.exp(share, out=share)
        share /= share.sum(axis=0)
        loss = -(w * np.log(np.maximum(share[at], 1e-30))).sum(dtype=float)
        share[at] -= 1
        delta = np.ascontiguousarray((share * w).T)
    else:
        gap = acts[-1] - y[:, None].astype(x.dtype)
        delta = gap * w[:, None]
        loss = 0.5 * (gap * delta).sum(dtype=float)
    out, every = [], np.ones(len(y), x.dtype)
    for i in range(len(weights) - 1, -1, -1):
        act = acts[i]
        out += [every @ delta, (act.T @ delta).ravel()]
        if i:
            delta = delta @ weights[i][0].T
            if classes:
                delta *= act
                delta *= np.subtract(1, act, out=act)
            else:
                delta *= act > 0
    return np.concatenate([[loss], *out[::-1]])


def _asker(blocks: RDD, layers: list[int], classes: bool, n: int) -> Callable:
    """A function from weights to the mean loss and its gradient, one job a call."""
    context, deep = blocks.context, blocks.getNumPartitions() > 64

    def ask(flat: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(flat.astype(np.float32))

        def part(rows: Iterator) -> Iterator[np.ndarray]:
            total = np.zeros(1 + len(shared.value))
            for x, y, w in rows:
                total += _gradient(x, y, shared.value, layers, classes, w)
            yield total

        sums = blocks.mapPartitions(part)
        total = (sums.treeReduce(np.add) if deep else sums.reduce(np.add)) / n
        shared.destroy()
        return float(total[0]), total[1:]

    return ask


def _adam(ask: Callable, flat: np.ndarray, steps: int, rate: float) -> np.ndarray:
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        _, g = ask(flat)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return flat


def lbfgs(ask: Callable, flat: np.ndarray, steps: int, memory: int = 10, window: int = 20, tol: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with backtracking; like Spark's own it ends where ``window`` steps gained less than ``tol`` of the first loss."""
    value, g = ask(flat)
    past, values, start = [], [value], abs(value)
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(back)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, t = float(d @ g), 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(g)))
        for _ in range(12):
            new, ahead = ask(flat + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t *= min(max(-slope * t / (2 * (new - value - slope * t)), 0.1), 0.5)
        else:
            if not past:
                break
            past = []
            continue
        s, y = t * d, ahead - g
        if s @ y > 1e-10 * np.sqrt((s @ s) * (y @ y)):
            past = [*past, (s, y)][-memory:]
        flat, value, g = flat + s, new, ahead
        values = [*values, value][-window - 1:]
        if max(values) - value <= tol * start and len(values) > window:
            break
    return flat


def _train(df: DataFrame, target: Column, ctx: Context, layers: list[int], spread: Callable, solve: Callable, classes: bool) -> dict:
    mean, std = _scaling(df)
    rng = np.random.default_rng(ctx.seed)
    flat = np.concatenate([np.concatenate([rng.normal(0, spread(a, b), a * b), np.zeros(b)]) for a, b in _shapes(layers)])
    blocks = weighted_blocks(df, target, mean, std)
    try:
        flat = solve(_asker(blocks, layers, classes, ctx.n), flat)
    finally:
        blocks.unpersist()
    return {"mean": mean, "std": std, "layers": layers, "weights": flat.tolist()}


def fit_mlp_classifier(df: DataFrame, ctx: Context, hidden: tuple = (128, 64), max_iter: int = 400) -> Fitted:
    """Sigmoid layers and cross-entropy, by L-BFGS."""
    layers = [ctx.width, *[max(8, ctx.scaled(h)) for h in hidden], max(2, ctx.classes)]
    params = _train(df, F.col("label"), ctx, layers, lambda a, b: np.sqrt(2.0 / (a + b)), lambda ask, flat: lbfgs(ask, flat, ctx.scaled(max_iter, 20)), True)
    return Fitted("mlp_class", [], {"has_probability": True, **params})


def fit_mlp_regressor(df: DataFrame, ctx: Context, hidden: tuple = (128, 64), max_iter: int = 400, rate: float = 0.01) -> Fitted:
    """Rectified layers and squared error, by Adam."""
    centre = df.agg(F.avg("label").alias("m")).first()["m"]
    layers = [ctx.width, *[max(8, ctx.scaled(h)) for h in hidden], 1]
    target = (F.col("label") - centre) / ctx.label_std
    params = _train(df, target, ctx, layers, lambda a, b: np.sqrt(2.0 / a), lambda ask, flat: _adam(ask, flat, ctx.scaled(max_iter, 20), rate), False)
    return Fitted("mlp_value", [], {**params, "centre": float(centre), "spread": float(ctx.label_std)})


def _outputs(model: Fitted, df: DataFrame, kind: str, finish: Callable) -> Column:
    p = model.params
    shared = df.sparkSession.sparkContext.broadcast((np.array(p["mean"]), np.array(p["std"]), np.array(p["weights"])))
    layers, classes = p["layers"], model.kind == "mlp_class"

    @F.pandas_udf(kind)
    def output(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        mean, std, flat = shared.value
        return pd.Series(finish(_forward((np.stack(x.to_numpy()) - mean) / std, _unpack(flat, layers), classes)[-1]))

    return output(vector_to_array("features"))


@predictor("mlp_class")
def _mlp_class(model: Fitted, df: DataFrame) -> DataFrame:
    out = df.withColumn("probability", _outputs(model, df, "array<double>", lambda z: list(_softmax(z))))
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


@predictor("mlp_value")
def _mlp_value(model: Fitted, df: DataFrame) -> DataFrame:
    centre, spread = model.params["centre"], model.params["spread"]
    return df.withColumn("prediction", _outputs(model, df, "double", lambda z: z[:, 0] * spread + centre))
