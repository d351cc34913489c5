"""Exact quantiles of many columns without holding all distinct values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.types import quoted

DIRECT_ROWS = 5_000_000
ACCURACY = 2_000


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5, direct_rows: int = DIRECT_ROWS) -> dict[str, float | None]:
    """Interpolated quantile ``q`` per column, NULL ignored.

    Spark's exact percentile keeps every distinct value of a column in one buffer. That is fine for a
    bounded number of rows only, so larger columns are narrowed first: each pass brackets the wanted
    ranks with a sketch, counts what lies below the bracket, and drops what lies outside it. Only the
    last bracket, at most ``direct_rows`` values per column, is ordered exactly.
    """
    if not columns:
        return {}
    counts = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    total = {c: counts[f"n{i}"] for i, c in enumerate(columns)}
    small = [c for c in columns if total[c] <= direct_rows]
    out: dict[str, float | None] = {}
    if small:
        row = df.agg(*[F.percentile(quoted(c).cast("double"), F.lit(q)).alias(f"v{i}") for i, c in enumerate(small)]).first()
        out.update({c: row[f"v{i}"] for i, c in enumerate(small)})

    open_columns = {}
    for c in columns:
        if c not in out:
            position = q * (total[c] - 1)
            open_columns[c] = {"lo": -math.inf, "hi": math.inf, "below": 0, "inside": total[c],
                               "first": math.floor(position), "last": math.ceil(position), "part": position - math.floor(position)}
    while open_columns:
        names = list(open_columns)
        sketch, bounds = [], {}
        for i, c in enumerate(names):
            s, v = open_columns[c], quoted(c).cast("double")
            inside = F.when((v >= F.lit(s["lo"])) & (v <= F.lit(s["hi"])), v)
            left = max(0.0, (s["first"] - s["below"]) / s["inside"] - 2 / ACCURACY)
            right = min(1.0, (s["last"] - s["below"] + 1) / s["inside"] + 2 / ACCURACY)
            sketch.append(F.percentile_approx(inside, [left, right], ACCURACY).alias(f"b{i}"))
        row = df.agg(*sketch).first()
        bounds = {c: row[f"b{i}"] for i, c in enumerate(names)}
        tally = []
        for i, c in enumerate(names):
            v, (lo, hi) = quoted(c).cast("double"), bounds[c]
            tally += [F.count_if(v < lo).alias(f"below{i}"), F.count_if((v >= lo) & (v <= hi)).alias(f"inside{i}")]
        row = df.agg(*tally).first()
        ready = []
        for i, c in enumerate(names):
            s, (lo, hi) = open_columns[c], bounds[c]
            below, inside = row[f"below{i}"], row[f"inside{i}"]
            if not (below <= s["first"] and s["last"] < below + inside):
                lo, hi, below, inside = s["lo"], s["hi"], s["below"], s["inside"]  # sketch missed: keep the old bracket
            stuck = inside >= s["inside"]
            s.update(lo=lo, hi=hi, below=below, inside=inside)
            if inside <= direct_rows or lo == hi or stuck:
                ready.append(c)
        for c in ready:
            s, v = open_columns.pop(c), quoted(c).cast("double")
            # Counts per value combine before the shuffle; a running total over values finds the two ranks.
            values = df.filter((v >= F.lit(s["lo"])) & (v <= F.lit(s["hi"]))).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            out[c] = _pick(values, s)
    return out


def _pick(values: DataFrame, s: dict) -> float:
    if s["lo"] == s["hi"]:
        return float(s["lo"])
    first, last = s["first"] - s["below"], s["last"] - s["below"]
    # The bracket is small by now, so its distinct values may be ordered in one task.
    running = values.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
    row = running.agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"),
                      F.min(F.when(F.col("upto") > last, F.col("v"))).alias("b")).first()
    return float(row["a"] + s["part"] * (row["b"] - row["a"]))
