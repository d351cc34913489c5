"""Scoring of batches and streams with a saved artifact."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import joined_text
from ..functions.types import quoted
from ..operators.features import label_decode
from ..operators.monitor import check_drift
from ..operators.scoring import positive_class_index, score_probability
from ..operators.usecases import get_use_case, tier_of
from ..sources.readers import check_columns
from ..sources.sinks import load_artifact, log_predictions


class SeriesModelRefused(ValueError):
    pass


def needs_batches(model) -> bool:
    """Whether a model can only score rows that are all there: nearest neighbours are found block by block."""
    return getattr(model, "kind", None) == "knn"


def score_frame(df: DataFrame, model, preprocessor, meta: dict, keep: list[str]) -> DataFrame:
    """Kept columns, decoded prediction, score, tier and action; one row for each input row, whatever the kept columns repeat.

    Narrow transforms and static joins only, but for nearest neighbours, which search per batch (``needs_batches``)."""
    if meta.get("problem_type") == "time_series":
        raise SeriesModelRefused("Time-series models do not support batch record prediction.")
    if meta.get("text_columns"):
        check_columns(df.columns, meta["text_columns"])
        ready = df.select(*[quoted(c) for c in keep], joined_text(meta["text_columns"]).alias("text"))
    else:
        features = preprocessor.transform(df, keep)
        renamed = features.select(*[quoted(c) for c in keep], *[quoted(c).cast("double").alias(f"_f{i}") for i, c in enumerate(preprocessor.feature_columns)])
        ready = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(preprocessor.feature_columns))], outputCol="features").transform(renamed)
        ready = ready.select(*[quoted(c) for c in keep], "features")
    predicted = model.transform(ready)
    has_probability = "probability" in predicted.columns
    has_margin = "margin" in predicted.columns
    index = positive_class_index(meta.get("classes") or [], meta.get("use_case_id"), meta.get("problem_type", ""))
    score = score_probability(F.col("probability") if has_probability else None, F.col("margin") if has_margin else None,
                              F.lit(index) if index is not None else None)
    decoded = label_decode(F.col("prediction"), meta["classes"]) if meta.get("classes") else F.col("prediction")
    out = predicted.select(*[quoted(c) for c in keep], decoded.alias("prediction"), score.alias("score"))
    template = get_use_case(meta.get("use_case_id"))
    if template is None or meta.get("problem_type") != "classification":
        return out
    tier = tier_of(F.col("score"), F.lit(template["high"]), F.lit(template["medium"]))
    action = F.coalesce(*[F.when(F.col("risk_tier") == t, text) for t, text in template["actions"].items()], F.lit("Review prediction manually."))
    return (out.withColumn("risk_tier", tier).withColumn("recommended_action", action)
            .withColumn("probability_label", F.lit(template["probability_label"])).withColumn("use_case_id", F.lit(template["id"])))


def score_batch(spark: SparkSession, artifact: str, records: DataFrame, keep: list[str], baseline: DataFrame | None = None,
                log: str | None = None, batch: str = "batch"):
    """Scored rows and, with a baseline, the drift warnings of the batch; with ``log``, the batch is logged there."""
    model, prep, meta = load_artifact(spark, artifact)
    scored = score_frame(records, model, prep, meta, keep)
    if log:
        log_predictions(scored, log, "prediction", [c for c in records.columns if c not in keep], batch, records)
    return scored, (check_drift(records, baseline) if baseline is not None else None)
