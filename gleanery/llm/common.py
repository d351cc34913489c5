"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut

#: White space between words, as a Java class body and as the characters themselves.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of (id, small value) that one broadcast may hold: about 32 MB.
SMALL_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Write a narrow table, count it, and mark it for broadcast only while it has at most ``rows`` rows; a larger
    one is joined by key."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(docs: DataFrame, stem: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two long columns that tell its rows apart, and their names.

    Rows of a Parquet table are named by their file (a 64-bit hash of its path) and their place in it, which no re-run changes,
    so nothing is written. Rows of any other plan are written with a running number.
    """
    names = [free_name(docs, f"{stem}_file"), free_name(docs, f"{stem}_at")]
    plan = docs._jdf.queryExecution().analyzed()
    scan = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    if scan and plan.relation().fileFormat().toString() == "Parquet" and "_metadata" not in {c.lower() for c in docs.columns}:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names
    return cut(docs.select("*", F.lit(0).cast("long").alias(names[0]), F.monotonically_increasing_id().alias(names[1]))), names


def small_bytes(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Mark a written table for broadcast only while its rows, measured and not estimated, take at most ``limit`` bytes."""
    size = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)) + 32
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def word_count(text: str | Column) -> Column:
    """Number of words, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), GAP_CHARS, " " * len(GAP_CHARS))), " +")
    return F.when(inner[0] == "", F.lit(0)).otherwise(F.size(inner)).cast("long")


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


class Hashes(dict):
    """64-bit hashes of byte strings, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound
        from xxhash import xxh64_intdigest
        self.digest = xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = self.digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(batches: Iterable[pa.RecordBatch], column: str = "text", rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of few rows with their texts, so that a batch of long texts never stands in memory twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
