"""Readers: CSV with inferred types, Parquet, JSON records against a fitted schema, image paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.types import nan_to_null, quoted

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEAN = ["True", "TRUE", "true", "False", "FALSE", "false"]


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def _cells_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell holds a line break: then a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).agg(F.bool_or(quotes % 2 == 1).alias("odd")).first()["odd"])


def scan_csv(spark: SparkSession, path: str, multiline: bool | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Read a CSV with a header; missing tokens become NULL before types are inferred.

    A file whose cells hold line breaks cannot be split among tasks, so that mode is used only where a
    first pass over the lines shows the need. ``types`` pins a schema found earlier and skips inference.
    """
    if multiline is None:
        multiline = _cells_span_lines(spark, path)
    raw = (spark.read.option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"')
           .option("nullValue", "\u0000").option("emptyValue", "").option("mode", "PERMISSIVE").csv(path))
    text = raw.select([F.when(~quoted(c).isin(NA_TOKENS), quoted(c)).alias(c) for c in raw.columns])
    found = types or infer_types(text)
    return text.select([_cast(c, found[c]).alias(c) for c in text.columns])


def infer_types(text: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double, boolean and string that fits every cell, from one aggregation."""
    exprs = []
    for i, c in enumerate(text.columns):
        v = F.trim(quoted(c))
        exprs += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.count_if(v.rlike(INTEGER) & v.try_cast("bigint").isNotNull()).alias(f"int{i}"),
            F.count_if(v.rlike(DECIMAL) | v.rlike(r"^[+-]?inf$")).alias(f"num{i}"),
            F.count_if(v.isin(BOOLEAN)).alias(f"bool{i}"),
        ]
    row = text.agg(*exprs).first()
    out = {}
    for i, c in enumerate(text.columns):
        n = row[f"n{i}"]
        out[c] = ("double" if n == 0 else "bigint" if row[f"int{i}"] == n else "double" if row[f"num{i}"] == n
                  else "boolean" if row[f"bool{i}"] == n else "string")
    return out


def _cast(name: str, kind: str):
    if kind == "string":
        return quoted(name)
    v = F.trim(quoted(name))
    if kind == "double":
        v = F.when(v.rlike("^[+-]?inf$"), F.replace(v, F.lit("inf"), F.lit("Infinity"))).otherwise(v)
    return v.try_cast(kind)


class MissingColumns(ValueError):
    pass


def check_columns(present: list[str], required: list[str]) -> None:
    missing = [c for c in required if c not in present]
    if missing:
        raise MissingColumns(f"Missing columns: {missing}. Required: {required}")


def scan_records(lines: DataFrame, column: str, schema: T.StructType | str, required: list[str] | None = None) -> DataFrame:
    """JSON records, one per row of ``column``, read against the fitted schema.

    A column counts as present when any record has it; one pass asks for the required names only.
    """
    if required:
        keys = F.json_object_keys(F.col(column))
        seen = lines.agg(*[F.bool_or(F.array_contains(keys, name)).alias(f"c{i}") for i, name in enumerate(required)]).first()
        check_columns([name for name, there in zip(required, seen) if there], required)
    return lines.select(F.from_json(F.col(column), schema).alias("r")).select("r.*")


def select_raw_inputs(df: DataFrame, required: list[str]) -> DataFrame:
    check_columns(df.columns, required)
    return df.select([quoted(c) for c in required])


def scan_image_paths(df: DataFrame, column: str, folder: str, least: int = 20) -> DataFrame | None:
    """Rows whose path is a readable image under ``folder``; fewer than ``least`` give none.

    A relative path must be the end of an image's path, folder by folder. An absolute one, which may be of another machine, must end with
    the image's path below ``folder``.
    """
    spark = df.sparkSession
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    bare = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    origin, path = F.col("i._origin"), F.regexp_replace(quoted(column), r"^(\./)+", "")
    known = images.select(name(F.col("image.origin")).alias("_file"), F.col("image.origin").alias("_origin")).alias("i")
    below = F.substring_index(origin, bare + "/", -1)
    absolute = path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    fits = F.when(absolute, path.endswith(F.concat(F.lit("/"), below))).otherwise(origin.endswith(F.concat(F.lit("/"), path)))
    found = df.join(known, (name(path) == F.col("i._file")) & fits, "left_semi")
    return found if found.limit(least).count() >= least else None
