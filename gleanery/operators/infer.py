"""What a table holds: dates, text, images, modality, and which task its target calls for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import parse_date_text
from ..functions.types import (
    datetime_typed_columns, distinct_key, is_numeric, is_numeric_or_bool, is_string, numeric_columns, quoted, string_columns, to_long,
)
from ..session import spread
from .profile import has_id_name

IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|gif|bmp|webp|tiff|tif)$"
# Fixed value.
ID_LIKE_NAMES = ["id", "uuid", "index", "key", "customer_id", "lead_id", "parentid"]


def detect_datetime(df: DataFrame, share: float = 0.8, years: tuple[int, int] = (1900, 2100)) -> DataFrame:
    """Text columns whose values parse as dates. All rows are looked at, so file order does not matter."""
    names = string_columns(df)
    exprs = []
    for i, c in enumerate(names):
        moment = parse_date_text(quoted(c))
        exprs += [
            F.count(quoted(c)).alias(f"n_values__{i}"), F.count(moment).alias(f"n_parsed__{i}"),
            F.min(F.year(moment)).alias(f"min_year__{i}"), F.max(F.year(moment)).alias(f"max_year__{i}"),
        ]
    row = df.agg(*exprs) if exprs else df.limit(0)
    out = to_long(row, names, {"n_values": "bigint", "n_parsed": "bigint", "min_year": "int", "max_year": "int"})
    ok = (
        (F.col("n_values") > 0) & (F.col("n_parsed") >= F.lit(share) * F.col("n_values"))
        & (F.col("min_year") >= years[0]) & (F.col("max_year") <= years[1])
    )
    return out.withColumn("is_datetime", F.coalesce(ok, F.lit(False)))


def _n_words(v: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(v, r"\s+", " "))
    return F.when(F.length(trimmed) == 0, F.when(v.isNotNull(), 0)).otherwise(F.size(F.split(trimmed, " ")))


def _text_facts(df: DataFrame, name: str) -> DataFrame:
    """One row: non-missing values of a column as text, their mean length and words, and how many differ.

    Values are counted as they are and turned into text once each. Long texts are counted by their digest and measured row by row.
    """
    c, dt = quoted(name), df.schema[name].dataType
    if is_string(dt) or not isinstance(dt, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        v, long = F.col("v"), F.length("v") > 32
        rows = spread(df.select(c.cast("string").alias("v")))
        values = rows.groupBy(F.when(long, F.md5(v)).otherwise(v).alias("v")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.when(long, F.length(v))).alias("len"), F.max(F.when(long, _n_words(v))).alias("words"))
    else:
        # Zero has two spellings among floating numbers, and a local time may come twice.
        zero = F.when(c == 0, c.cast("string")) if isinstance(dt, (T.FloatType, T.DoubleType)) else F.lit(None).cast("string")
        values = df.groupBy(c.alias("k"), zero.alias("zero")).agg(F.count(F.lit(1)).alias("n"))
        values = values.select(F.coalesce("zero", F.col("k").cast("string")).alias("v"), "n", F.lit(None).cast("int").alias("len"), F.lit(None).cast("int").alias("words"))
        if isinstance(dt, T.TimestampType):
            values = values.groupBy("v").agg(F.sum("n").alias("n"), F.max("len").alias("len"), F.max("words").alias("words"))
    known = values.filter(F.col("v").isNotNull())
    mean = lambda what: F.sum(F.col("n") * what) / F.nullif(F.sum("n"), F.lit(0))
    return known.agg(F.lit(name).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), mean(F.coalesce("len", F.length("v"))).alias("avg_len"),
                     mean(F.coalesce("words", _n_words(F.col("v")))).alias("avg_words"), F.count(F.lit(1)).alias("n_unique"))


def detect_text(df: DataFrame, target: str | None = None, strict: bool = False, skip: list[str] | None = None) -> DataFrame:
    """Columns that hold free text, from lengths, word counts and distinct share of the stringified values.

    ``strict`` looks at string columns only and leaves out those in ``skip``, the identifiers and dates found before
    (they are looked for when not given), as well as single words that differ in every row.
    """
    if strict and skip is None:
        skip = [c for c in df.columns if has_id_name(c)] + datetime_columns(df)
    out_of_play = {target, *(skip or [])} if strict else {target}
    names = [f.name for f in df.schema if f.name not in out_of_play and (is_string(f.dataType) or not strict)]
    out = df.sparkSession.createDataFrame([], "column string, n_values bigint, avg_len double, avg_words double, n_unique bigint")
    if names:
        out = reduce(DataFrame.unionByName, [_text_facts(df, c) for c in names])
    ratio = F.col("n_unique") / F.col("n_values")
    hit = (
        (F.col("avg_len") > 35) | ((F.col("avg_len") > 12) & (ratio > 0.3))
        | ((F.col("avg_len") > 8) & (F.col("n_unique") > 10)) | ((F.col("avg_words") >= 3) & (F.col("avg_len") > 15))
    )
    if strict:
        hit = hit & ~((F.col("n_unique") == F.col("n_values")) & (F.col("n_values") > 20) & (F.col("avg_words") < 2))
    return out.withColumn("is_text", F.coalesce((F.col("n_values") > 0) & hit, F.lit(False)))


def detect_image(df: DataFrame, target: str | None = None, share: float = 0.6) -> DataFrame:
    """Columns whose values end in an image suffix."""
    names = [f.name for f in df.schema if f.name != target]
    exprs = []
    for i, c in enumerate(names):
        v = quoted(c).cast("string")
        exprs += [F.count(v).alias(f"n_values__{i}"), F.count_if(v.rlike(IMAGE_SUFFIX)).alias(f"n_image__{i}")]
    out = to_long(df.agg(*exprs), names, {"n_values": "bigint", "n_image": "bigint"})
    ok = (F.col("n_values") > 0) & (F.col("n_image") >= F.lit(share) * F.col("n_values"))
    return out.withColumn("is_image", ok)


def modality_columns(df: DataFrame, target: str | None = None, strict: bool = False, skip: list[str] | None = None) -> DataFrame:
    """One row per column with its role flags; numeric does not exclude text, categorical does."""
    text = detect_text(df, target, strict, skip).select("column", "is_text")
    image = detect_image(df, target).select("column", "is_image")
    numeric = set(numeric_columns(df))
    roles = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c in numeric).alias("is_numeric"), F.lit(c == target).alias("is_target"))
        for c in df.columns
    ]))
    base = df.sparkSession.range(1).select(roles)
    return (base.join(text, "column", "left").join(image, "column", "left")
            .withColumn("is_text", F.coalesce("is_text", F.lit(False)))
            .withColumn("is_image", F.coalesce("is_image", F.lit(False)))
            .withColumn("is_categorical", ~F.col("is_numeric") & ~F.col("is_text") & ~F.col("is_target")))


def roll_up_modality(roles: DataFrame) -> DataFrame:
    flags = roles.agg(
        F.bool_or(F.col("is_numeric") | F.col("is_categorical")).alias("has_tabular"),
        F.bool_or("is_text").alias("has_text"), F.bool_or("is_image").alias("has_image"),
    )
    tab, text, image = F.col("has_tabular"), F.col("has_text"), F.col("has_image")
    primary = (
        F.when(image & (text | tab), "multimodal").when(image, "image")
        .when(text & tab, "multimodal").when(text, "text").otherwise("tabular")
    )
    listed = F.concat_ws(",", F.when(tab, "tabular"), F.when(text, "text"), F.when(image, "image"))
    n = tab.cast("int") + text.cast("int") + image.cast("int")
    return flags.select(primary.alias("primary_modality"), listed.alias("modalities"), (n > 1).alias("is_multimodal"),
                        "has_tabular", "has_text", "has_image")


def detect_modality(df: DataFrame, target: str | None = None, strict: bool = False) -> DataFrame:
    return roll_up_modality(modality_columns(df, target, strict))


def _target_facts(df: DataFrame, name: str, dt: T.DataType) -> DataFrame:
    """One row: non-missing values of a column, how many differ, and whether all are whole. They are counted by value."""
    key = distinct_key(name, dt).alias("k")
    values = (spread(df.select(key)) if is_string(dt) else df).groupBy("k" if is_string(dt) else key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("k").isNotNull())
    whole = F.bool_and(F.col("k") == F.round("k")) if is_numeric(dt) else F.lit(dt.typeName() == "boolean")
    return values.agg(F.lit(name).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.count(F.lit(1)).alias("n_unique"), whole.alias("whole"))


def target_statistics(df: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """Facts about each candidate target that the task and validity rules need. Each column is read and counted by itself, so no row is multiplied."""
    types = {f.name: f.dataType for f in df.schema}
    present = [c for c in (candidates or df.columns) if c in types]
    out = df.sparkSession.createDataFrame([], "column string, n_values bigint, n_unique bigint, whole boolean")
    if present:
        out = reduce(DataFrame.unionByName, [_target_facts(df, c, types[c]) for c in present])
    numeric = [c for c in present if is_numeric_or_bool(types[c])]
    return out.withColumn("is_num", F.col("column").isin(numeric) if numeric else F.lit(False))


def _looks_like_id(name: Column) -> Column:
    clean = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    return clean.isin(ID_LIKE_NAMES) | clean.endswith("_id") | clean.endswith("id")


def validate_target(df: DataFrame, candidates: list[str] | None = None, allow_continuous: bool = False) -> DataFrame:
    """The first rule each candidate target breaks, or ``ok``; plus a warning flag."""
    wanted = candidates or df.columns
    stats = target_statistics(df, wanted)
    ratio = F.col("n_unique") / F.col("n_values")
    # A numeric target that is not whole numbers may be accepted as a regression outcome.
    continuous = F.lit(allow_continuous) & F.col("is_num") & ~F.coalesce("whole", F.lit(False))
    status = (
        F.when(F.col("n_values") < 10, "too_few_rows")
        .when(F.col("n_unique") <= 1, "single_value")
        .when((F.col("n_unique") == F.col("n_values")) & (F.col("n_unique") > 20) & ~continuous, "unique_identifier")
        .when(_looks_like_id(F.col("column")) & (ratio > 0.85) & ~continuous, "looks_like_id")
        .when((F.col("n_unique") > 500) & (ratio > 0.8) & ~continuous, "too_many_values")
        .otherwise("ok")
    )
    out = stats.select("column", "n_values", "n_unique", status.alias("status")).withColumn(
        "many_values_warning", (F.col("status") == "ok") & (ratio > 0.5) & (F.col("n_unique") > 50))
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        rows = [(c, 0, 0, "missing_column", False) for c in absent]
        kinds = "column string, n_values bigint, n_unique bigint, status string, many_values_warning boolean"
        out = out.unionByName(df.sparkSession.createDataFrame(rows, kinds))
    return out


def problem_type_of(stats: DataFrame, has_datetime: bool) -> DataFrame:
    """Task per candidate target from its statistics."""
    few = (F.col("n_unique") <= 20) & ((F.col("n_unique") / F.col("n_values") < 0.3) | (F.col("n_unique") <= 10))
    task = (
        F.when(F.lit(has_datetime) & F.col("is_num"), "time_series")
        .when(F.col("is_num") & few & F.coalesce("whole", F.lit(True)), "classification")
        .when(F.col("is_num"), "regression").otherwise("classification")
    )
    return stats.select("column", task.alias("problem_type"))


def detect_problem_type(df: DataFrame, target: str | None, has_datetime: bool | None = None) -> str:
    """Task for one target; no target, or an absent one, means clustering."""
    if target is None or target not in df.columns:
        return "clustering"
    if has_datetime is None:
        has_datetime = bool(datetime_columns(df, target))
    return problem_type_of(target_statistics(df, [target]), has_datetime).first()["problem_type"]


def datetime_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Names of typed and detected date columns (a list as long as the schema)."""
    found = [r["column"] for r in detect_datetime(df).filter("is_datetime").collect()] if string_columns(df) else []
    return [c for c in df.columns if c != target and (c in found or c in datetime_typed_columns(df))]


def class_count(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count_distinct(quoted(target)).alias("n_classes"))
