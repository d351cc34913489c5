"""Mixing sources to target weights by balanced sampling: the cube method, block by block."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import free_name, numbered, small, word_count

#: Documents whose probabilities are moved together.
BLOCK = 1000
#: A document is taken at most so often, and a source's target stops at so many times its size.
MOST = 3


def targets(sizes: dict, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict:
    """Words to take from each source: shares of the total by weight, in code point order with null last; a target stops at ``most`` times its
    source, and the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_names, out = float(sum(sizes.values())), list(names), {}
    while open_names:
        unit = left / sum(weight[s] for s in open_names)
        full = [s for s in open_names if weight[s] * unit >= most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_names}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_names = [s for s in open_names if s not in out]
    return out


def flight(sizes: np.ndarray, chance: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities until at most two lie strictly between 0 and 1.

    Three open documents at a time move along the direction that changes neither the expected number of words nor of
    documents; a random sign weighted by the reach either way keeps every probability right on average.
    """
    p, tiny = chance.astype(np.float64).copy(), 1e-9
    open_rows: list[int] = []
    for k in range(len(p)):
        if tiny < p[k] < 1 - tiny:
            open_rows.append(k)
        while len(open_rows) == 3:
            a, b, c = sizes[open_rows]
            u = np.array([b - c, c - a, a - b], np.float64) if not a == b == c else np.array([1.0, -1.0, 0.0])
            q = p[open_rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
                down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
            q = q + up * u if draw.random() * (up + down) < down else q - down * u
            p[open_rows] = np.where(q < tiny, 0.0, np.where(q > 1 - tiny, 1.0, q))
            open_rows = [k for k in open_rows if 0 < p[k] < 1]
    return np.where(p <= tiny, 0.0, np.where(p >= 1 - tiny, 1.0, p))


def landing(sizes: np.ndarray, p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round the last open probabilities, then exchange documents while that brings the words nearer to what was expected.

    Of all ways to round the open ones, the one nearest in words, then in documents, is taken. An exchange flips one or two
    documents of the block that could go either way.
    """
    rows = np.flatnonzero((p > 0) & (p < 1))
    best = min(product((0.0, 1.0), repeat=len(rows)),
               key=lambda pick: (abs(float(np.dot(sizes[rows], np.array(pick) - p[rows]))), abs(float(np.sum(np.array(pick) - p[rows]))), pick))
    out = p.copy()
    out[rows] = best
    free = np.flatnonzero((chance > 0) & (chance < 1) & (sizes > 0))
    expected = float(np.dot(sizes, chance))
    for _ in range(8):
        off = expected - float(np.dot(sizes, out))
        if len(free) < 2 or abs(off) < 0.5:
            break
        gain = sizes[free] * (1 - 2 * out[free])
        order = np.argsort(gain, kind="stable")
        near = np.clip(np.searchsorted(gain[order], off - gain), 1, len(free) - 1)
        tries = [(abs(off - g), (i,)) for i, g in enumerate(gain)]
        tries += [(abs(off - gain[i] - gain[k]), (i, int(k))) for i in range(len(free)) for k in order[near[i] - 1:near[i] + 1] if k != i]
        left, flips = min(tries)
        if left >= abs(off):
            break
        out[free[list(flips)]] = 1 - out[free[list(flips)]]
    return out


def _mover(seed: int, level: int, blocks: dict[int, int]):
    def move(key, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values(["_order", "doc_id", "size"], kind="stable")
        draw = np.random.Generator(np.random.PCG64([seed, level, int(key[0]), int(key[1])]))
        size = data["size"].to_numpy(np.float64)
        chance = data["_open"].to_numpy(np.float64)
        p = flight(size, chance, draw)
        return data.assign(_open=landing(size, p, chance) if blocks[int(key[0])] == 1 else p).drop(columns="_block")

    return move


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 5) -> DataFrame:
    """``rows`` with (source_size, target, copies): how often each document is taken.

    ``rows`` has doc_id, source and size among its columns. A source whose target is r times its size gives every document
    floor(r) copies and one more to a balanced sample at rate r - floor(r). Probabilities move within blocks of one
    source; what a block leaves open, at most two documents, meets again in the next round, until one block per source is
    left to land. Blocks and draws depend on ids and sizes only, so reruns and other file layouts agree; rows alike in both are
    interchangeable. Sizes of 0 and sources without words are taken as often as their source's rate says, 0 for
    the latter. An empty table gives an empty result. One row per source passes through the driver.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["source"]: int(r["size"] or 0) for r in sums}
    goal = targets(sizes, weights)
    facts = [(i, s, sizes[s], float(goal[s]), goal[s] / sizes[s] if sizes[s] else 0.0) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))]
    spark = rows.sparkSession
    per_source = spark.createDataFrame(facts, "_source_no int, source string, source_size long, target double, _rate double")
    known = rows.alias("r").join(F.broadcast(per_source).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        *[F.col(f"r.`{c}`") for c in rows.columns], "_source_no", "source_size", "target", F.floor("_rate").cast("int").alias("copies"),
        (F.col("_rate") - F.floor("_rate")).alias("_open"), F.xxhash64("r.doc_id", F.lit(seed)).alias("_order"))
    decided, open_rows, left = [], known, {r["source"]: r["n"] for r in sums}
    level, number = 0, {s: i for i, s, *_ in facts}
    while left:
        blocks = {number[s]: -(-n // BLOCK) for s, n in left.items()}
        split = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(blocks.items()) for x in kv]), F.col("_source_no"))
        dealt = open_rows.withColumn("_block", F.pmod(F.xxhash64("_order", F.lit(level)), split.cast("long")))
        moved = cut(dealt.groupBy("_source_no", "_block").applyInPandas(_mover(seed, level, blocks), open_rows.schema))
        whole = F.col("_open").isin(0.0, 1.0)
        decided.append(moved.filter(whole))
        open_rows = moved.filter(~whole)
        left = {r["source"]: r["n"] for r in open_rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        level += 1
    if not decided:
        return rows.withColumn("source_size", F.lit(0).cast("long")).withColumn("target", F.lit(0.0)).withColumn("copies", F.lit(0))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("copies") + F.col("_open").cast("int")).drop("_source_no", "_open", "_order")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size) of every document; null texts have size 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), *more)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs`` alone.

    Null texts and texts without words have size 0; rows without doc_id or source, repeated rows and an empty table are treated as ``mix``
    says. Rows are told apart by ``numbered``; the decisions go to the texts, and texts move only where there are more decisions than
    ``small`` allows.
    """
    known, names = numbered(docs, "_mix")
    times = free_name(known, "_mix_times")
    taken = mix(cut(sized(known, *names)), weights).filter("copies > 0")
    found = known.join(small(taken.select(*names, F.col("copies").alias(times))), names)
    copy = free_name(found, "_mix_copy")
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(*[F.col(f"`{c}`") for c in docs.columns])
