"""Splits and folds that depend on row keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import bucket_of, row_token
from ..functions.types import quoted
from .lookup import broadcast_if_small
from .position import with_position


def test_flag(keys: list[str], seed: int | None = None) -> Column:
    """True for the fifth of the rows held out for testing."""
    return bucket_of(keys, 5, seed) == 0


def train_test_split(df: DataFrame, keys: list[str], seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("_test", test_flag(keys, seed))
    return flagged.filter(~F.col("_test")).drop("_test"), flagged.filter("_test").drop("_test")


def ordered_split(df: DataFrame, order: str, keys: list[str] | None = None, tie: str | None = None, share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of each series as training rows. Works for a single series of any length."""
    keys = keys or []
    placed = with_position(df, order, tie, keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total")) if keys else df.agg(F.count(F.lit(1)).alias("n_total"))
    joined = placed.join(sizes, keys, "left") if keys else placed.join(F.broadcast(sizes))
    return joined.withColumn("train_size", F.floor(F.lit(share) * F.col("n_total"))).withColumn(
        "is_train", F.col("position") <= F.col("train_size"))


def kfold_assign(keys: list[str], folds: int, seed: int | None = None) -> Column:
    return bucket_of(keys, folds, seed)


def fold_count(n_models: int) -> int:
    """Three folds for a long list of models, five for a short one."""
    return 3 if n_models > 10 else 5


def stratified_folds(df: DataFrame, target: str, keys: list[str], folds: int) -> DataFrame:
    """Deal the rows of each class to the folds in turn.

    A class may hold a third of the table, so it is dealt in 65536 hash ranges: a row's turn is the number of
    rows in the ranges before it plus its rank in its own range.
    """
    token = row_token(keys)
    tie = F.concat_ws("|", *[quoted(k).cast("string") for k in keys])
    marked = df.withColumn("_token", token).withColumn("_range", F.shiftright(F.col("_token"), 16)).withColumn("_tie", tie)
    sizes = marked.groupBy(target, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(target).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(sizes.select(
        F.col(target).alias("_class"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    rank = F.row_number().over(Window.partitionBy(target, "_range").orderBy("_token", "_tie"))
    ranked = marked.withColumn("_rank", rank)
    joined = ranked.join(offsets, F.col(target).eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_r")))
    fold = F.pmod(F.col("_rank") + F.col("_before") - 1, F.lit(folds)).cast("int")
    return joined.select(*[quoted(c) for c in df.columns], fold.alias("fold"))


def dropna_subset(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
