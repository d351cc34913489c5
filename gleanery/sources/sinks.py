"""Sinks: reports, model artifacts, runs, analyses, prediction log. All are tables under a given folder."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..models.base import Fitted
from ..models.texts import TextModel
from ..operators.features import Preprocessor
from ..operators.monitor import prediction_log_entry
from ..operators.usecases import get_use_case


def _now() -> datetime:
    return datetime.now(timezone.utc)


def report_name(use_case_id: str | None = None, at: datetime | None = None) -> str:
    template = get_use_case(use_case_id)
    return f"{template['report_prefix'] if template else 'prediction_report'}_{(at or _now()).strftime('%Y%m%d_%H%M%S')}.csv"


def write_report_csv(report: DataFrame, folder: str, use_case_id: str | None = None, at: datetime | None = None) -> str:
    """Write a report as a CSV folder of part files; returns its path."""
    path = f"{folder.rstrip('/')}/{report_name(use_case_id, at)}"
    report.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


# ---------------------------------------------------------------- models

def save_artifact(spark: SparkSession, path: str, model, preprocessor: Preprocessor | None, meta: dict) -> str:
    """Model, preprocessing and a one-row description: classes, inputs, template, task, target."""
    model.save(spark, f"{path}/model")
    if preprocessor is not None:
        preprocessor.save(spark, f"{path}/preprocessor")
    body = {**meta, "is_text": isinstance(model, TextModel), "has_preprocessor": preprocessor is not None, "saved_at": _now().isoformat()}
    spark.createDataFrame([(json.dumps(body),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_artifact(spark: SparkSession, path: str):
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    model = (TextModel if meta["is_text"] else Fitted).load(spark, f"{path}/model")
    prep = Preprocessor.load(spark, f"{path}/preprocessor") if meta["has_preprocessor"] else None
    return model, prep, meta


def artifact_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def promote_model(spark: SparkSession, staged: str, production: str, confirmed: bool, versions: str | None = None) -> str:
    """Load the staged artifact and save it for production; refused without confirmation or without a staged model."""
    if not confirmed:
        raise PermissionError("Approval was not confirmed.")
    if not artifact_exists(spark, staged):
        raise FileNotFoundError("No staged model found. Run an analysis first.")
    model, prep, meta = load_artifact(spark, staged)
    save_artifact(spark, production, model, prep, {k: v for k, v in meta.items() if k not in ("is_text", "has_preprocessor", "saved_at")})
    if versions:
        spark.createDataFrame([(uuid.uuid4().hex, staged, production, _now().isoformat())],
                              "version_id string, staged string, production string, promoted_at string").write.mode("append").parquet(versions)
    return production


# ---------------------------------------------------------------- runs

RUN_SCHEMA = "run_id string, run_name string, status string, params map<string,string>, metrics map<string,double>, logged_at timestamp"


def log_run(spark: SparkSession, path: str, source: str, problem_type: str, best_model: str, leakage: list[str],
            n_rows: int, n_cols: int, leaderboard: DataFrame | None = None) -> str:
    """Append one run with its parameters, table size and the numbers of the leaderboard's first row."""
    run_id = uuid.uuid4().hex
    params = {"source_file": source, "problem_type": problem_type, "best_model": best_model,
              "leakage_warnings": ",".join(leakage) if leakage else "none"}
    metrics = {"n_rows": float(n_rows), "n_cols": float(n_cols)}
    top = leaderboard.first() if leaderboard is not None else None
    if top is not None:
        metrics.update({f"best_{k}": float(v) for k, v in top.asDict().items()
                        if isinstance(v, (int, float)) and not isinstance(v, bool)})
    spark.createDataFrame([(run_id, source, "FINISHED", params, metrics, _now())], RUN_SCHEMA).write.mode("append").partitionBy("run_id").parquet(path)
    return run_id


def get_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Parameters, metrics and status of one run; only its partition is read."""
    return spark.read.parquet(path).filter(F.col("run_id") == run_id).select("run_id", "params", "metrics", "status")


def save_analysis(spark: SparkSession, path: str, analysis: dict, at: datetime | None = None) -> None:
    spark.createDataFrame([(at or _now(), json.dumps(analysis, default=str))], "saved_at timestamp, analysis string").write.mode("append").parquet(path)


def latest_of(runs: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """The newest row per key; an aggregation, so a key with very many runs is no hot spot."""
    picked = runs.groupBy(*keys).agg(F.max_by(F.struct(at, *values), F.struct(at, *values)).alias("_r"))
    return picked.select(*keys, "_r.*")


def latest_analysis(spark: SparkSession, path: str) -> dict | None:
    """The newest stored analysis; an absent or unreadable store gives none."""
    try:
        row = spark.read.parquet(path).agg(F.max_by("analysis", "saved_at").alias("a")).first()
        return json.loads(row["a"]) if row and row["a"] else None
    except Exception:  # noqa: BLE001 - any unreadable store counts as empty
        return None


def log_predictions(df: DataFrame, path: str, prediction: str, inputs: list[str], batch: str, records: DataFrame | None = None,
                    part: str | None = None) -> None:
    """Append every prediction of a batch, and one row with its size and input means (of ``records``, if given).

    With ``part`` the rows go to a folder of that name and replace what an earlier try left there.
    """
    at, mode, own = F.lit(_now()), "overwrite" if part else "append", f"/{part}" if part else ""
    df.select(F.lit(batch).alias("batch"), at.alias("timestamp"), F.col(prediction).cast("string").alias("prediction")).write.mode(mode).parquet(f"{path}/predictions{own}")
    entry = prediction_log_entry((df if records is None else records).withColumn("_b", F.lit(batch)), inputs, "_b")
    entry.withColumn("timestamp", at).write.mode(mode).parquet(f"{path}/batches{own}")


def save_baseline(baseline: DataFrame, path: str, model_id: str) -> None:
    baseline.withColumn("model_id", F.lit(model_id)).withColumn("saved_at", F.lit(_now())).write.mode("append").partitionBy("model_id").parquet(path)


def load_baseline(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """The newest baseline of a model."""
    rows = spark.read.parquet(path).filter(F.col("model_id") == model_id)
    return latest_of(rows, ["column"], "saved_at", ["mean", "std"]).select("column", "mean", "std")
