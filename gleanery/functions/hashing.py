"""Deterministic pseudo-random keys: the same row gets the same split, fold or sample on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_token(keys: list[str | Column], seed: int | None = None) -> Column:
    """32-bit number from the md5 of the key columns; portable to any SQL engine."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    text = F.concat_ws("|", *([F.lit(str(seed))] if seed is not None else []), *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket_of(keys: list[str | Column], buckets: int, seed: int | None = None) -> Column:
    return (row_token(keys, seed) % F.lit(buckets)).cast("int")
