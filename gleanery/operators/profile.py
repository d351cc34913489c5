"""Column profiles. Statistics of all columns come from one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.types import distinct_key, is_numeric_or_bool, quoted, to_long

# Fixed value.
ID_NAMES = ["id", "uuid", "index", "key"]


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing count and share, distinct values without NULL.

    The exact distinct counts share one expand-and-aggregate with partial deduplication on the
    map side; ``approximate`` swaps them for sketches, which need no shuffle of values.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        exprs += [F.count_if(quoted(f.name).isNull()).alias(f"missing_count__{i}"), distinct(distinct_key(f.name, f.dataType)).alias(f"unique_count__{i}")]
    row = df.agg(*exprs)
    types = dict(df.dtypes)
    wide = row.select("*", *[
        F.when(F.col("n") > 0, F.round(F.lit(100.0) * F.col(f"missing_count__{i}") / F.col("n"), 2)).alias(f"missing_pct__{i}")
        for i in range(len(df.columns))
    ], *[F.lit(types[c]).alias(f"dtype__{i}") for i, c in enumerate(df.columns)],
        *[F.col("n").alias(f"n_rows__{i}") for i in range(len(df.columns))])
    return to_long(wide, df.columns, {
        "dtype": "string", "missing_count": "bigint", "missing_pct": "double", "unique_count": "bigint", "n_rows": "bigint",
    })


def profile_numeric(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum; booleans count as numbers. No shuffle of rows."""
    names = [f.name for f in df.schema if is_numeric_or_bool(f.dataType)]
    exprs = []
    for i, c in enumerate(names):
        v = quoted(c).cast("double")
        exprs += [F.avg(v).alias(f"mean__{i}"), F.stddev_samp(v).alias(f"std__{i}"),
                  F.min(v).alias(f"min__{i}"), F.max(v).alias(f"max__{i}")]
    row = df.agg(*exprs) if exprs else df.agg(F.count(F.lit(1)).alias("n"))
    return to_long(row, names, {"mean": "double", "std": "double", "min": "double", "max": "double"})


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, count) for the given columns, values as text. Hot values combine before the shuffle."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in names]))
    return df.select(cells).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent values of every non-numeric column; ties go to the smaller value.

    The rank filter is pushed below the shuffle as a group limit, so a task sends at most
    ``limit`` rows per column however many distinct values there are.
    """
    names = [f.name for f in df.schema if not is_numeric_or_bool(f.dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint, rank int")
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    counts = value_counts(df, names).filter(F.col("value").isNotNull())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The whole profile, one row per column, top values nested. Every input has one row per column."""
    tops = top_values(df).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                    lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias("top_values"))
    base = profile_columns(df, approximate)
    return base.join(profile_numeric(df), "column", "left").join(tops, "column", "left")


def profile_summary(columns: DataFrame, unique_over: int = 50) -> DataFrame:
    """How many columns have missing values, and how many have many distinct values."""
    return columns.agg(F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
                       F.count_if(F.col("unique_count") > unique_over).alias("high_cardinality_columns"))


def has_id_name(name: str) -> bool:
    return name.lower() in ID_NAMES or name.lower().endswith("id")


def flag_id_columns(columns: DataFrame) -> DataFrame:
    """Columns that look like row identifiers, by name or because every row differs."""
    name = F.lower(F.col("column"))
    by_name = name.isin(ID_NAMES) | name.endswith("id")
    by_value = (F.col("unique_count") == F.col("n_rows")) & (F.col("unique_count") > 20)
    return columns.select("column", (by_name | by_value).alias("is_id"))
