"""Online scoring, drift and profiling as streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.types import is_numeric_or_bool, quoted
from ..operators.monitor import check_drift, with_drift
from ..plans.scoring import needs_batches, score_frame
from ..sources.sinks import log_predictions


def read_stream(spark, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder, or matching a pattern (the source takes no single file)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_score(stream: DataFrame, model, preprocessor, meta: dict, out: str, checkpoint: str, keep: list[str],
                 log: str | None = None, baseline: DataFrame | None = None) -> StreamingQuery:
    """Score an unbounded record stream and append predictions, tiers and actions.

    Preprocessing is expressions and static joins, so scoring needs no state; the file sink makes the output
    exactly-once. With ``log``, each trigger also logs its predictions and input means there and, given a ``baseline``,
    its drift warnings. It then writes folders of its own, so a trigger that runs again replaces what it left; so does a
    model that needs whole batches.
    """
    if baseline is not None and log is None:
        raise ValueError("Drift warnings of a stream need a log folder.")
    if log is not None or needs_batches(model):
        inputs = [c for c in stream.columns if c not in keep]

        def store(batch: DataFrame, epoch: int) -> None:
            trigger = f"epoch={epoch}"
            score_frame(batch, model, preprocessor, meta, keep).write.mode("overwrite").parquet(f"{out}/{trigger}")
            if log is None:
                return
            scored = batch.sparkSession.read.parquet(f"{out}/{trigger}")
            log_predictions(scored, log, "prediction", inputs, f"stream-{epoch}", batch, trigger)
            if baseline is not None:
                check_drift(batch, baseline).write.mode("overwrite").parquet(f"{log}/drift/{trigger}")

        return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    scored = score_frame(stream, model, preprocessor, meta, keep)
    return (scored.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def windowed_means(df: DataFrame, ts: str, columns: list[str], width: str = "1 day", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Mean of each column per event-time window, in long form; partial averages combine before the shuffle.

    On a stream, rows later than ``late`` behind the newest are dropped and a window is emitted once it is closed.
    """
    timed = df.withWatermark(ts, late) if df.isStreaming and late else df
    span = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    wide = timed.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("batch_mean")) for i, c in enumerate(columns)])
    return wide.select(F.col("w.start").alias("window_start"), "n", F.inline(cells))


def drift_rows(df: DataFrame, baseline: DataFrame, ts: str, columns: list[str], **window) -> DataFrame:
    return with_drift(windowed_means(df, ts, columns, **window), baseline)


def stream_drift(stream: DataFrame, baseline: DataFrame, ts: str, columns: list[str], out: str, checkpoint: str, **window) -> StreamingQuery:
    """Compare each closed window to the training baseline; the baseline has one row per column."""
    rows = drift_rows(stream, baseline, ts, columns, **window)
    return (rows.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_profile(df: DataFrame) -> DataFrame:
    """Column statistics as one row: counts, missing, sketched distinct values, moments. State is one row."""
    numeric = [f.name for f in df.schema if is_numeric_or_bool(f.dataType)]
    exprs = [F.count(F.lit(1)).alias("n_rows")]
    for c in df.columns:
        exprs += [F.count_if(quoted(c).isNull()).alias(f"{c}__missing_count"), F.approx_count_distinct(quoted(c)).alias(f"{c}__unique_count")]
    for c in numeric:
        v = quoted(c).cast("double")
        exprs += [F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    return df.agg(*exprs)


def profile_long(row: DataFrame, schema) -> DataFrame:
    """One row per column from the running profile."""
    numeric = {f.name for f in schema if is_numeric_or_bool(f.dataType)}
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(f.name).alias("column"), F.col("n_rows"), quoted(f"{f.name}__missing_count").alias("missing_count"),
                      quoted(f"{f.name}__unique_count").alias("unique_count"),
                      *[(quoted(f"{f.name}__{m}") if f.name in numeric else none).alias(m) for m in ("mean", "std", "min", "max")])
             for f in schema]
    return row.select(F.inline(F.array(*cells)))


def stream_profile(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the profile of all files seen so far. Each trigger writes a table of its own; readers of an earlier one go on."""
    profile = running_profile(stream)

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (profile.writeStream.outputMode("complete").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_profile(spark, out: str, schema) -> DataFrame:
    """The profile after the newest trigger, one row per column."""
    rows = spark.read.parquet(out)
    newest = rows.agg(F.max("epoch").alias("e")).first()["e"]
    return profile_long(rows.filter(F.col("epoch") == newest).drop("epoch"), schema)
