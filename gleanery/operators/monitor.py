"""Training baseline, batch means and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import is_numeric, numeric_columns, quoted, to_long


def training_baseline(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of every numeric column that varies; one aggregation."""
    names = [c for c in numeric_columns(df) if c not in (exclude or [])]
    exprs = []
    for i, c in enumerate(names):
        exprs += [F.avg(quoted(c).cast("double")).alias(f"mean__{i}"), F.stddev_samp(quoted(c).cast("double")).alias(f"std__{i}")]
    row = df.agg(*exprs) if exprs else df.limit(0)
    return to_long(row, names, {"mean": "double", "std": "double"}).filter(F.col("std") > 0)


def batch_means(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean per numeric column; an empty batch gives no rows."""
    names = columns if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, batch_mean double")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c).cast("double")).alias(f"batch_mean__{i}") for i, c in enumerate(names)])
    return to_long(row.filter("n > 0"), names, {"batch_mean": "double"})


def drift_message(column: Column, batch: Column, z: Column, mean: Column) -> Column:
    return F.format_string("%s: incoming mean %.3f deviates %.1fσ from training (%.3f)", column, batch, z, mean)


def with_drift(means: DataFrame, baseline: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Join batch means to the baseline: one row per shared column with its z value and warning flag.

    Both sides have one row per column, so the baseline is broadcast (also into a stream).
    """
    base = baseline.select("column", "mean", "std")
    z = F.abs(F.col("batch_mean") - F.col("mean")) / F.col("std")
    return means.join(F.broadcast(base), "column").withColumn("z", z).withColumn("is_drift", F.col("z") > threshold)


def check_drift(batch: DataFrame, baseline: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Warnings for the columns whose batch mean lies more than ``threshold`` deviations from training."""
    rows = with_drift(batch_means(batch), baseline, threshold).filter("is_drift")
    return rows.select("column", "batch_mean", "mean", "z", drift_message(F.col("column"), F.col("batch_mean"), F.col("z"), F.col("mean")).alias("warning"))


def prediction_log_entry(df: DataFrame, inputs: list[str], batch: str | None = None) -> DataFrame:
    """One log row per batch: its size and the mean of each numeric input. Sums combine before the shuffle."""
    types = {f.name: f.dataType for f in df.schema}
    names = [c for c in inputs if is_numeric(types[c])]
    by = F.col(batch).cast("string") if batch else F.lit("batch")
    pairs = [x for c in names for x in (F.lit(c), F.avg(quoted(c).cast("double")))]
    means = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    return df.groupBy(by.alias("batch")).agg(F.count(F.lit(1)).alias("n_records"), means.alias("input_means"))
