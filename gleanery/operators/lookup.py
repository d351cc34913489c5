"""Left join of a large table to a table of per-value facts, safe for hot values and for large fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut

BROADCAST_ROWS = 200_000
HOT_SHARE = 256
SPREAD = 1024


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a summary table, count it, and mark it for broadcast only when it is small."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= rows else table


def lookup_join(df: DataFrame, facts: DataFrame, key: str, weight: str, values: list[str],
                n_facts: int, total: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``values`` from ``facts`` (unique on ``key``) to ``df``; no match gives NULL.

    ``n_facts`` is the counted size of ``facts`` and ``total`` the sum of its ``weight`` column. A small
    fact table is broadcast and nothing shuffles. A larger one is split: values that own at least
    1/256 of the rows (so at most 256 of them) are broadcast, the rest join by key. Rows already
    served by the first join, and rows without a key, get a spread-out key that matches nothing, so no
    task receives a hot group.
    """
    slim = facts.select(key, weight, *values)
    if n_facts <= broadcast_rows:
        return df.join(F.broadcast(slim.drop(weight)), key, "left").select(*df.columns, *values)
    threshold = max(1, total // HOT_SHARE)
    hot = slim.filter(F.col(weight) >= threshold).select(
        F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = slim.filter(F.col(weight) < threshold).select(
        F.concat(F.lit("v"), F.col(key)).alias("_cold_key"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    served = df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    spread = F.concat(F.lit("s"), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SPREAD)).cast("string"))
    keyed = served.withColumn(
        "_join_key", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.concat(F.lit("v"), F.col(key))).otherwise(spread))
    joined = keyed.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    return joined.select(*[F.col(c) for c in df.columns], *[
        F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values
    ])
