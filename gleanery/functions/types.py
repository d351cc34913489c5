"""Column classes and null normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    """Numbers only; a boolean is categorical here."""
    return isinstance(dt, NUMERIC)


def is_numeric_or_bool(dt: T.DataType) -> bool:
    """The wider notion used by profiling and target checks, where a boolean counts as a number."""
    return is_numeric(dt) or isinstance(dt, T.BooleanType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_string(f.dataType)]


def datetime_typed_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_datetime(f.dataType)]


def quoted(name: str):
    """Column by name, safe for dots and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(name: str):
    return quoted(name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN would count as a value in averages, medians and distinct counts."""
    if not any(isinstance(f.dataType, FLOATING) for f in df.schema):
        return df
    return df.select([
        F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name)
        if isinstance(f.dataType, FLOATING) else quoted(f.name)
        for f in df.schema
    ])


def distinct_key(name: str, dt: T.DataType):
    """What to count distinct: long texts by their digest, so that whole texts do not travel through a shuffle."""
    c = quoted(name)
    return F.when(F.length(c) > 32, F.md5(c)).otherwise(c) if is_string(dt) else c


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select([quoted(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select([quoted(c) for c in categorical_columns(df)])


def to_long(row: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row frame of ``<field>__<i>`` columns into one row per source column.

    ``fields`` maps the output field to its SQL type.
    """
    structs = [
        F.struct(F.lit(c).alias("column"),
                 *[quoted(f"{name}__{i}").cast(kind).alias(name) for name, kind in fields.items()])
        for i, c in enumerate(columns)
    ]
    if not structs:
        schema = "column string, " + ", ".join(f"{n} {k}" for n, k in fields.items())
        return row.sparkSession.createDataFrame([], schema)
    return row.select(F.inline(F.array(*structs)))
