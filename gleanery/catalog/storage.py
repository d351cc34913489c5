"""Sources, sinks and streams: each query writes with the library and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as mo
from ..session import fresh_path
from ..sources import readers, sinks
from ..streaming import jobs
from .registry import GAPS_SQL, events_with_gaps, query, table


@query("scan_csv", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey ELSE -1 END AS o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
  round(o_totalprice, 2) AS o_totalprice, o_orderkey % 2 = 0 AS even, 'say "' || o_orderstatus || '", ok' AS note FROM orders""")
def scan_csv(spark, sf):
    k = F.col("o_orderkey")
    path = fresh_path(spark, "orders-csv")
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 4 != 0, F.col("o_custkey").cast("string")).otherwise("NA").alias("o_custkey"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).otherwise("n/a").alias("o_orderpriority"), F.round("o_totalprice", 2).alias("o_totalprice"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("even"), F.concat(F.lit('say "'), "o_orderstatus", F.lit('", ok')).alias("note"))
    text.write.option("header", True).option("escape", '"').csv(path)
    return readers.scan_csv(spark, path).withColumn("o_totalprice", F.round("o_totalprice", 2)).fillna(-1, ["o_custkey"])


@query("scan_records", f"SELECT event_id, user_id, event_type, round(value, 4) AS value FROM {GAPS_SQL}")
def scan_records(spark, sf):
    lines = events_with_gaps(spark, sf).select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("line"))
    out = readers.scan_records(lines, "line", "event_id bigint, user_id bigint, event_type string, value double", ["event_id", "user_id"])
    return out.withColumn("value", F.round("value", 4))


@query("sink_report_csv", """SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS prediction, round(CAST(c_custkey % 101 AS DOUBLE) / 100, 4) AS churn_probability,
  round(CAST(c_custkey % 101 AS DOUBLE), 1) AS churn_probability_pct FROM customer""")
def sink_report_csv(spark, sf):
    from ..operators.scoring import build_report

    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(k % 2 == 0, "Yes").otherwise("No").alias("said"), ((k % 101).cast("double") / 100).alias("p"))
    path = sinks.write_report_csv(build_report(rows, ["c_custkey", "c_mktsegment"], "said", "p", "churn_probability"), fresh_path(spark, "report"), "customer_churn")
    return readers.scan_csv(spark, path)


_RUNS = "(SELECT o_orderpriority AS dataset, o_orderdate AS saved_at, o_orderkey AS run, round(o_totalprice, 2) AS score FROM orders)"


@query("latest_analysis", f"SELECT dataset, run, score FROM {_RUNS} QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY saved_at DESC, run DESC) = 1")
def latest_analysis(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").alias("saved_at"), F.col("o_orderkey").alias("run"), F.round("o_totalprice", 2).alias("score"))
    path = fresh_path(spark, "analyses")
    runs.write.mode("append").parquet(path)
    return sinks.latest_of(spark.read.parquet(path), ["dataset"], "saved_at", ["run", "score"]).select("dataset", "run", "score")


@query("save_latest_analysis", "SELECT count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_segments FROM customer")
def save_latest_analysis(spark, sf):
    path = fresh_path(spark, "analysis")
    facts = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("c_mktsegment").alias("n_segments")).first().asDict()
    sinks.save_analysis(spark, path, {"n_rows": -1, "n_segments": -1})
    sinks.save_analysis(spark, path, facts)
    found = sinks.latest_analysis(spark, path)
    return spark.createDataFrame([(found["n_rows"], found["n_segments"])], "n_rows bigint, n_segments bigint")


@query("log_run", """SELECT 'orders' AS source_file, 'classification' AS problem_type, 'none' AS leakage_warnings, 'FINISHED' AS status,
  CAST(count(*) AS DOUBLE) AS n_rows, 6.0::DOUBLE AS n_cols, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 4) AS best_test_score FROM orders""")
def log_run(spark, sf):
    orders, path = table(spark, sf, "orders"), fresh_path(spark, "runs")
    board = orders.agg(F.lit("always F").alias("model"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 4).alias("test_score"))
    sinks.log_run(spark, path, "other", "clustering", "none", ["leak"], 0, 0)
    run = sinks.log_run(spark, path, "orders", "classification", "always F", [], orders.count(), len(orders.columns), board)
    return sinks.get_run(spark, path, run).select(
        F.col("params")["source_file"].alias("source_file"), F.col("params")["problem_type"].alias("problem_type"), F.col("params")["leakage_warnings"].alias("leakage_warnings"),
        "status", *[F.col("metrics")[m].alias(m) for m in ("n_rows", "n_cols", "best_test_score")])


@query("get_run", "SELECT count(*) AS n_rows, 'lines' AS source_file FROM lineitem")
def get_run(spark, sf):
    path = fresh_path(spark, "runs")
    run = sinks.log_run(spark, path, "lines", "regression", "none", [], table(spark, sf, "lineitem").count(), 11)
    return sinks.get_run(spark, path, run).select(F.col("metrics")["n_rows"].cast("bigint").alias("n_rows"), F.col("params")["source_file"].alias("source_file"))


@query("log_predictions", """SELECT event_type AS batch, count(*) AS n_records, round(avg(value), 4) AS mean_value, round(avg(user_id), 4) AS mean_user,
  count(*) FILTER (value > 50) AS n_high FROM events GROUP BY event_type""")
def log_predictions(spark, sf):
    events = table(spark, sf, "events").withColumn("said", F.when(F.col("value") > 50, "high").otherwise("low"))
    path = fresh_path(spark, "log")
    entry = mo.prediction_log_entry(events, ["value", "user_id", "props"], "event_type")
    entry.write.mode("append").parquet(f"{path}/batches")
    events.select(F.col("event_type").alias("batch"), F.col("said").alias("prediction")).write.mode("append").parquet(f"{path}/predictions")
    high = spark.read.parquet(f"{path}/predictions").groupBy("batch").agg(F.count_if(F.col("prediction") == "high").alias("n_high"))
    return spark.read.parquet(f"{path}/batches").join(high, "batch").select(
        "batch", "n_records", F.round(F.col("input_means")["value"], 4).alias("mean_value"), F.round(F.col("input_means")["user_id"], 4).alias("mean_user"), "n_high")


# ---------------------------------------------------------------- streams

_BASE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std FROM events" for c in ("value", "user_id"))


@query("stream_drift", f"""WITH w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n, avg(value + CASE WHEN day(ts) % 10 = 0 THEN 500 ELSE 0 END) AS value, avg(user_id) AS user_id FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1),
  l AS (SELECT window_start, n, 'value' AS "column", value AS m FROM w UNION ALL SELECT window_start, n, 'user_id', user_id FROM w)
  SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, n, l."column", round(m, 4) AS batch_mean, round(abs(m - mean) / std, 4) AS z, abs(m - mean) / std > 3 AS is_drift FROM l JOIN ({_BASE}) b ON b."column" = l."column" """)
def stream_drift(spark, sf):
    events = table(spark, sf, "events")
    baseline = mo.training_baseline(events.select("value", "user_id"))
    raw = spark.read.parquet(f"{sf}/events.parquet")
    stream = jobs.read_stream(spark, f"{sf}/events*.parquet", raw.schema)
    shifted = stream.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("value") + F.when(F.day("ts") % 10 == 0, 500).otherwise(0)).alias("value"))
    out = fresh_path(spark, "drift")
    job = jobs.stream_drift(shifted, baseline, "ts", ["value", "user_id"], out, fresh_path(spark, "drift-state"))
    job.awaitTermination()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "column",
                                          F.round("batch_mean", 4).alias("batch_mean"), F.round("z", 4).alias("z"), "is_drift")


@query("stream_drift_sliding", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, 'value' AS "column", round(avg(value), 4) AS batch_mean FROM (
  SELECT value, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS s FROM events) GROUP BY s""")
def stream_drift_sliding(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.windowed_means(events, "ts", ["value"], "2 days", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "column", F.round("batch_mean", 4).alias("batch_mean"))


_PROFILED = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("stream_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing_count, true AS unique_close, """
    + (", ".join(f"round(CAST({f}({c}) AS DOUBLE), 3) AS {n}" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) if c in ("event_id", "user_id", "value")
       else ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "max"))) + " FROM events" for c in _PROFILED))
def stream_profile(spark, sf):
    """The sketched distinct counts must lie within a seventh of the exact ones."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = fresh_path(spark, "profile")
    job = jobs.stream_profile(jobs.read_stream(spark, f"{sf}/events*.parquet", events.schema), out, fresh_path(spark, "profile-state"))
    job.awaitTermination()
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in _PROFILED]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in _PROFILED])))
    found = jobs.latest_profile(spark, out, events.schema).join(F.broadcast(exact), "column")
    return found.select("column", "n_rows", "missing_count", (F.abs(F.col("unique_count") - F.col("exact")) * 7 <= F.col("exact")).alias("unique_close"),
                        *[F.round(m, 3).alias(m) for m in ("mean", "std", "min", "max")])
