"""From model output to business output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import quoted
from .usecases import get_use_case, recommended_action, risk_tier, use_case_catalog


def positive_class_index(classes: list[str], use_case_id: str | None, problem_type: str = "classification") -> int | None:
    """Place of the template's positive class; 1 when absent (0 with a single class); none without a template."""
    template = get_use_case(use_case_id)
    if template is None or problem_type != "classification":
        return None
    if template["positive_class"] in classes:
        return classes.index(template["positive_class"])
    return 1 if len(classes) > 1 else 0


def positive_index_column(classes: Column, use_case: Column, positive: Column) -> Column:
    """The same rule for rows that carry their own class list and template."""
    found = F.array_position(classes, positive)
    fallback = F.when(F.size(classes) > 1, 1).otherwise(0)
    return F.when(use_case.isNull() | positive.isNull(), None).when(found > 0, found - 1).otherwise(fallback).cast("int")


def score_probability(probability: Column | None, margin: Column | None, index: Column | None) -> Column:
    """Positive-class probability, else the largest one, else a squashed margin, else NULL."""
    out = F.lit(None).cast("double")
    if margin is not None:
        out = F.when(margin.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
    if probability is not None:
        best = F.array_max(probability)
        chosen = best if index is None else F.coalesce(F.get(probability, index), best)
        out = F.coalesce(chosen, out)
    return out


def business_output(df: DataFrame, probability: str, use_case: str = "use_case_id") -> DataFrame:
    """Label, rounded score, tier, action and template name for rows with a classification template."""
    tiered = recommended_action(risk_tier(df, probability, use_case), use_case)
    info = use_case_catalog(df.sparkSession).filter("problem_type = 'classification'").select(
        F.col("use_case_id").alias("_uc"), F.col("name").alias("use_case"), "probability_label", "high_risk_label")
    joined = tiered.join(F.broadcast(info), F.col(use_case) == F.col("_uc"), "inner").drop("_uc")
    score = F.round(F.col(probability), 4)
    return joined.withColumn("probability_score", score).withColumn(
        "churn_probability", F.when(F.col(use_case) == "customer_churn", score))


def build_report(df: DataFrame, inputs: list[str], prediction: str, probability: str | None = None,
                 label: str = "probability", tier: str | None = None, action: str | None = None) -> DataFrame:
    """Input columns, prediction, rounded probability and percentage, tier and action."""
    out = [quoted(c) for c in inputs] + [quoted(prediction).alias("prediction")]
    if probability:
        p = quoted(probability).cast("double")
        out += [F.round(p, 4).alias(label), F.round(p * 100, 1).alias(f"{label}_pct")]
    if tier:
        out.append(quoted(tier).alias("risk_tier"))
    if action:
        out.append(quoted(action).alias("recommended_action"))
    return df.select(*out)
