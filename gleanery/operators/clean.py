"""Duplicates, missing values, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.types import categorical_columns, numeric_columns, quoted
from .profile import value_counts
from .quantiles import exact_quantiles


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates go, NULL equals NULL. Copies combine on the map side before the shuffle."""
    return df.dropDuplicates()


def drop_id_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def medians(df: DataFrame, columns: list[str] | None = None) -> dict[str, float | None]:
    return exact_quantiles(df, columns if columns is not None else numeric_columns(df), 0.5)


def modes(df: DataFrame, columns: list[str] | None = None) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on a tie, as text; one value per column comes back."""
    names = columns if columns is not None else categorical_columns(df)
    if not names:
        return {}
    counts = value_counts(df, names).filter(F.col("value").isNotNull())
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))
    found = {r["column"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in names}


def impute_median(df: DataFrame, columns: list[str] | None = None, fitted: dict | None = None) -> DataFrame:
    """Numeric NULL becomes the exact median; a column without values stays NULL.

    Whole-number columns keep their type while the median is whole, and become double otherwise.
    """
    names = columns if columns is not None else numeric_columns(df)
    values = fitted if fitted is not None else medians(df, names)
    types = dict(df.dtypes)

    def filled(c):
        whole = types[c] in ("tinyint", "smallint", "int", "bigint") and (values.get(c) is None or float(values[c]).is_integer())
        kind = types[c] if whole else "double"
        return F.coalesce(quoted(c).cast(kind), F.lit(values.get(c)).cast(kind))

    return df.select([filled(c).alias(c) if c in names else quoted(c) for c in df.columns])


def impute_mode(df: DataFrame, columns: list[str] | None = None, fitted: dict | None = None) -> DataFrame:
    """Non-numeric NULL becomes the mode, or ``Unknown`` where a column has no value at all."""
    names = columns if columns is not None else categorical_columns(df)
    values = fitted if fitted is not None else modes(df, names)
    types = dict(df.dtypes)

    def filled(c):
        if values.get(c) is None:
            return F.coalesce(quoted(c), F.lit("Unknown")) if types[c] == "string" else quoted(c)
        return F.coalesce(quoted(c), F.lit(values[c]).cast(types[c]))

    return df.select([filled(c).alias(c) if c in names else quoted(c) for c in df.columns])


def impute_auto(df: DataFrame) -> DataFrame:
    return impute_mode(impute_median(df))


def correlations(df: DataFrame, target: str) -> DataFrame:
    """Absolute Pearson correlation of every numeric column with a numeric target, pairwise complete, in one pass."""
    names = [c for c in numeric_columns(df) if c != target]
    if target not in numeric_columns(df) or not names:
        return df.sparkSession.createDataFrame([], "column string, abs_corr double")
    y = quoted(target).cast("double")
    row = df.agg(*[F.corr(quoted(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"r{i}")).alias("abs_corr")) for i, c in enumerate(names)])
    return row.select(F.inline(cells))


def detect_leakage(df: DataFrame, target: str, threshold: float = 0.98) -> DataFrame:
    return correlations(df, target).filter((F.col("abs_corr") > threshold) & ~F.isnan("abs_corr"))
