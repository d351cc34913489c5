"""Parsing of date text. One format list serves detection and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .types import datetime_typed_columns, quoted

# Accepted shapes, each with the pattern that parses it.
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{4}$", "yyyy"),
]


def parse_date_text(c: Column) -> Column:
    """Timestamp without zone, or NULL when no format fits. The shape test keeps each cell to one parse."""
    text = F.trim(c)
    out = F.lit(None).cast("timestamp_ntz")
    for shape, pattern in reversed(DATE_FORMATS):
        out = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")).otherwise(out)
    return out


def as_moment(df: DataFrame, name: str) -> Column:
    """A typed timestamp for a date column, whether it is text or already typed."""
    if name in datetime_typed_columns(df):
        return quoted(name).cast("timestamp_ntz")
    return parse_date_text(quoted(name).cast("string"))
