"""Where queries are collected, and the small helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.readers import scan_parquet

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


# Planted gaps: the tables hold no NULL, so both sides blank the same cells by key.
GAPS_SQL = """(SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value, props FROM events)"""


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"),
                    F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), "props")


def token_sql(*keys: str, seed: int | None = None) -> str:
    parts = ([f"'{seed}'"] if seed is not None else []) + [f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_cents"]


def lines_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the price in cents, which completes its row key in a form all engines print alike."""
    return table(spark, sf_dir, "lineitem").withColumn("l_cents", F.round(F.col("l_extendedprice") * 100).cast("long"))


LINES_SQL = "(SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents FROM lineitem)"
