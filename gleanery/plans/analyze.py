"""The whole analysis: profile, infer, clean, featurise, train, explain, stage, log."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import bucket_of
from ..functions.types import categorical_columns, nan_to_null, quoted
from ..models.bank import Spec
from ..models.texts import NgramFront, TextModel
from ..operators import advisor, clean, explain, infer
from ..operators.evaluate import accuracy, class_report, confusion, f1_weighted, forecast_scores, regression_scores
from ..operators.features import Preprocessor
from ..operators.iforest import detect_anomalies
from ..operators.monitor import training_baseline
from ..operators.profile import has_id_name, profile
from ..operators.usecases import get_use_case, resolve_target
from ..session import cut, fresh_path, keep
from ..sources.sinks import log_run, save_analysis, save_artifact, save_baseline
from . import training

ROW_ID = "_row_id"


@dataclass
class Analysis:
    problem_type: str
    profile: DataFrame
    leaderboard: DataFrame
    best_name: str | None
    explanation: DataFrame
    leakage: list[str] = field(default_factory=list)
    target_status: str | None = None
    target_warning: bool = False
    failed: dict[str, str] = field(default_factory=dict)
    architectures: DataFrame | None = None
    n_classes: int | None = None
    run_id: str | None = None
    artifact: str | None = None


def row_identity(df: DataFrame) -> DataFrame:
    """The digest of all cells names a row on any cluster; to be taken right after deduplication, while no two rows are alike."""
    text = F.concat_ws("\u0001", *[F.coalesce(quoted(c).cast("string"), F.lit("\u0000")) for c in df.columns])
    return df.withColumn(ROW_ID, F.md5(text))


def named_and_filled(raw: DataFrame) -> DataFrame:
    """Distinct rows with a name and without gaps. They are named while ids and gaps are still there: two customers may be alike
    in all else, or in what fills a gap."""
    named = row_identity(cut(clean.dedupe_rows(raw)))
    return clean.impute_mode(clean.impute_median(named), categorical_columns(raw))


def explain_report(result: training.TrainingResult, problem_type: str, feature_columns: list[str], train: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Long report: (section, key, name, value).

    ``method`` names how importance was found and for which model, ``class_label`` the classes of the test rows by their number in the
    other sections, ``warning`` what could not be explained and which models failed to train.
    """
    spark = result.best.sparkSession if isinstance(result.best, DataFrame) else result.test.sparkSession
    said: list[tuple[str, str, str, float | None]] = [("warning", name, str(problem), None) for name, problem in sorted(result.failed.items())]

    def rows(df: DataFrame, section: str, key, name, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), name.cast("string").alias("name"), value.cast("double").alias("value"))

    if problem_type == "clustering":
        wide = result.best.select("cluster", *[F.get("x", i).alias(c) for i, c in enumerate(feature_columns)])
        parts = [
            rows(explain.cluster_importance(wide, "cluster", feature_columns, n), "importance", F.lit("Between-cluster variance"), F.col("feature"), F.col("importance")),
            rows(explain.cluster_profiles(wide, "cluster", feature_columns, n), "cluster_profile", F.col("cluster"), F.col("feature"), F.col("mean_value")),
            rows(explain.cluster_metrics(wide, "cluster"), "metric", F.lit("cluster_profile"), F.lit("n_clusters"), F.col("n_clusters")),
        ]
        method = "cluster_profile"
    elif problem_type == "time_series":
        scores = forecast_scores(result.best.filter(F.col("model") == result.best_name), ["series"])
        parts = [rows(scores, "forecast_summary", F.col("series"), F.lit(m), F.col(m)) for m in ("train_size", "test_size", "test_mae", "test_rmse")]
        method = "forecast"
    else:
        method = "none"
        predicted = keep(result.best.transform(result.test))
        if problem_type == "classification":
            report = class_report(predicted, "label", "prediction")
            parts = [rows(accuracy(predicted, "label", "prediction"), "metric", F.lit("test"), F.lit("accuracy"), F.col("accuracy")),
                     rows(f1_weighted(predicted, "label", "prediction"), "metric", F.lit("test"), F.lit("f1_weighted"), F.col("f1_weighted")),
                     rows(confusion(predicted, "label", "prediction"), "confusion", F.col("actual"), F.col("predicted"), F.col("n")),
                     *[rows(report, "class_report", F.col("label"), F.lit(m), F.col(m)) for m in ("precision", "recall", "f1", "support")]]
        else:
            scores = regression_scores(predicted, "label", "prediction")
            parts = [rows(scores, "metric", F.lit("test"), F.lit(m), F.col(m)) for m in ("r2", "mae", "rmse")]
        if problem_type == "classification":
            names = result.classes or []
            present = sorted(int(r["label"]) for r in predicted.select("label").distinct().collect())  # no more than there are classes
            said += [("class_label", str(c), str(names[c]) if c < len(names) else str(c), float(c)) for c in present]
        if result.kind == "tabular":
            method, importance = _importance(result, feature_columns, problem_type, rows, n)
            parts.append(importance)
        elif isinstance(result.best, TextModel):
            tokens = text_tokens(result.best, result.test, n)
            if tokens is not None:
                method = "text_saliency"
                parts.append(rows(tokens, "text_tokens", F.lit("Linear saliency"), F.col("token"), F.col("score")))
            else:
                said.append(("warning", str(result.best_name), "The model has no weight for a single word, so no word is named.", None))
    said.append(("method", method, str(result.best_name), None))
    parts.append(spark.createDataFrame(said, "section string, key string, name string, value double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_tokens(model: TextModel, texts: DataFrame, n: int = 10) -> DataFrame | None:
    """The n-grams that move a linear text model most: total weight over all texts times the largest coefficient.

    Weights are never negative, so one vector sum over the texts replaces a row per text and n-gram.
    """
    part = model.inner.parts[0] if model.inner.parts else None
    if not isinstance(model.front, NgramFront) or not (hasattr(part, "coefficientMatrix") or hasattr(part, "coefficients")):
        return None
    sums = model.front.transform(texts, "text").agg(Summarizer.metrics("sum").summary(F.col("features")).alias("s")).first()["s"]["sum"].toArray()
    coefficients = np.abs(part.coefficientMatrix.toArray() if hasattr(part, "coefficientMatrix") else part.coefficients.toArray()[None, :]).max(axis=0)
    scores = [(w, round(float(v), 4)) for w, v in zip(model.front.counter.vocabulary, sums * coefficients)]
    table = texts.sparkSession.createDataFrame(scores, "token string, score double")
    return table.filter("score > 0").orderBy(F.col("score").desc(), F.col("token")).limit(n)


def _importance(result, names, problem_type, rows, n) -> tuple[str, DataFrame]:
    model, spark = result.best, result.test.sparkSession
    part = model.parts[0] if model.kind == "spark" else None
    kind = type(part).__name__ if part is not None else ""
    if model.kind in ("grown", "boosted") or "Tree" in kind or "GBT" in kind:
        long = explain.shap_long(explain.shap_tree(result.test, model), names)
        top = explain.shap_aggregate(long, n)
        return "shap", rows(top, "importance", F.lit("SHAP (Shapley additive values)"), F.col("feature"), F.col("importance"))
    if kind == "LinearRegressionModel" or (kind == "LogisticRegressionModel" and part.numClasses == 2):
        x = vector_to_array("features")
        wide = result.test.select(*[x[i].alias(c) for i, c in enumerate(names)])
        coefs = dict(zip(names, part.coefficients.toArray().tolist()))
        top = explain.shap_importance(explain.shap_linear(wide, coefs), names, n=n)
        return "shap", rows(top, "importance", F.lit("SHAP (Shapley additive values)"), F.col("feature"), F.col("importance"))
    top = explain.permutation_importance(result.test, model.transform, problem_type, names, n=n)
    return "permutation", rows(top, "importance", F.lit("Permutation importance"), F.col("feature"), F.col("importance"))


def _better(tabular: training.TrainingResult | None, text: training.TrainingResult) -> training.TrainingResult:
    """One leaderboard of both banks; the side whose model leads it is explained and staged."""
    if tabular is None:
        return text
    board = training.leaderboard_union(tabular.leaderboard, text.leaderboard)
    top = board.first()["model"]
    chosen = text if top in text.models else tabular
    chosen.leaderboard = board
    return chosen


def run_analysis(df: DataFrame, target: str | None = None, use_case_id: str | None = None, source: str = "table",
                 bank: list[Spec] | None = None, folds: int | None = None, budget: float = 1.0, id_columns: list[str] | None = None,
                 allow_continuous: bool = False, series: str | None = None, folder: str | None = None, trees: int = 100,
                 cluster_options: dict | None = None, seed: int = 42) -> Analysis:
    """Run every stage on ``df``. Driver decisions rest on aggregates only; rows stay distributed.

    Preprocessing is fitted on the training rows alone and replayed on the test rows. The drift baseline is taken from
    the cleaned inputs, on the scale batches arrive in.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "analysis")
    template = get_use_case(use_case_id)
    target = resolve_target(target, use_case_id)
    ids = list(id_columns or []) or (template["id_columns"] if template else [])

    # Profile and inference look at the raw table; what they find is one row per column.
    raw = nan_to_null(df)
    columns = cut(profile(raw))
    dates = infer.datetime_columns(raw, target)
    named_ids = [c for c in raw.columns if has_id_name(c)]
    roles = cut(infer.modality_columns(raw, target, strict=True, skip=[*dates, *named_ids, *ids]))
    modality = infer.roll_up_modality(roles).first()
    text_columns = [r["column"] for r in roles.filter("is_text").collect()]

    # Cleaning. Deduplication is the one shuffle of whole rows, so its result is written once and read from there.
    cleaned = detect_anomalies(named_and_filled(raw), trees=trees)
    cleaned = cut(clean.drop_id_columns(cleaned, [i for i in ids if i != ROW_ID]))

    status, warning, leakage = None, False, []
    if target:
        status = infer.validate_target(cleaned.drop(ROW_ID, "is_anomaly"), [target], allow_continuous).first()
        status, warning = status["status"], bool(status["many_values_warning"])
        if status != "ok":
            raise ValueError(f"Target column '{target}' cannot be used: {status}")
        leakage = [r["column"] for r in clean.detect_leakage(cleaned, target).collect()]
    task = infer.detect_problem_type(cleaned.drop(ROW_ID), target, bool(dates))
    n_classes = infer.class_count(cleaned, target).first()["n_classes"] if task == "classification" else None
    descriptor = spark.createDataFrame([(source, task, bool(modality["has_text"]), bool(modality["has_image"]), bool(modality["is_multimodal"]))],
                                       "dataset string, problem_type string, has_text boolean, has_image boolean, is_multimodal boolean")
    plan = advisor.recommend_architectures(descriptor)

    inputs = cleaned.drop(*[c for c in ("is_anomaly",) if c in cleaned.columns])
    baseline = training_baseline(inputs, exclude=[target] if target else [])
    save_baseline(baseline, f"{folder}/baseline", source)

    prep = None
    text_columns = [c for c in text_columns if c in cleaned.columns and c != target]
    whole = cleaned.dropna(subset=[*text_columns, *([target] if target else [])])
    n_text = whole.limit(training.MIN_APPEND_ROWS).count() if text_columns else 0
    trainers = training.choose_task(task, len(text_columns), n_text, 0, both=True)
    if "time_series" in trainers:
        result = training.train_series(cleaned, dates[0], target, series)
        names = []
    else:
        prep = Preprocessor()
        if "clustering" in trainers:
            features = prep.fit_transform(cleaned, None, dates, [ROW_ID, *text_columns], [ROW_ID])
            # Clusters are formed on the scaled numbers; dummies stay out.
            dummies = {f"{c}_{v}" for c, values in prep.categories.items() for v in values[1:]}
            names = [c for c in prep.feature_columns if c not in dummies]
            result = training.train_clusters(features, names, ROW_ID, seed=seed, **(cluster_options or {}))
        else:
            known_text = cleaned.dropna(subset=[target])
            known = known_text.drop(*text_columns)
            flagged = known.withColumn("_test", bucket_of([ROW_ID], 5, seed) == 0)
            train_rows, test_rows = flagged.filter("not _test").drop("_test"), flagged.filter("_test").drop("_test")
            train = prep.fit_transform(train_rows, target, dates, [ROW_ID], [ROW_ID])
            names = prep.feature_columns
            test = prep.transform(test_rows, [target, ROW_ID])
            both = train.select(target, ROW_ID, *[quoted(c) for c in names]).unionByName(test.select(target, ROW_ID, *[quoted(c) for c in names]))
            # A table of ids and texts only has nothing for the tabular bank.
            result = training.train_tabular(cut(both), names, target, task, ROW_ID, use_case_id, bank, budget, folds, seed=seed) if names else None
            if "text" in trainers or "sequence" in trainers:
                text = training.train_text(known_text, text_columns, target, ROW_ID, budget, seed=seed, problem_type=task)
                if text is not None:
                    result = _better(result, text)
            if result is None:
                raise ValueError("No column is left to learn from.")

    report = explain_report(result, task, names) if result.best is not None else spark.createDataFrame([], "section string, key string, name string, value double")
    artifact = None
    if task in ("classification", "regression") and result.best is not None:
        meta = {"problem_type": task, "classes": result.classes, "target": target, "use_case_id": use_case_id, "best_model": result.best_name,
                "raw_input_columns": prep.raw_input_columns, "feature_columns": prep.feature_columns,
                "text_columns": text_columns if result.kind == "text" else []}
        artifact = save_artifact(spark, f"{folder}/staging", result.best, None if result.kind == "text" else prep, meta)
    shape = columns.agg(F.max("n_rows").alias("n")).first()
    run_id = log_run(spark, f"{folder}/runs", source, task, result.best_name or "none", leakage, shape["n"] or 0, len(raw.columns), result.leaderboard)
    # Everything kept here has as many rows as there are models, features or columns.
    as_rows = lambda d: [r.asDict() for r in d.collect()]
    save_analysis(spark, f"{folder}/analyses", {
        "run_id": run_id, "source": source, "target": target, "use_case_id": use_case_id, "problem_type": task, "best_model": result.best_name,
        "n_classes": n_classes, "leakage": leakage, "target_warning": warning, "failed": result.failed, "leaderboard": as_rows(result.leaderboard),
        "explanation": as_rows(report), "architectures": as_rows(plan), "modality": modality.asDict()})
    return Analysis(task, columns, result.leaderboard, result.best_name, report, leakage, status, warning, result.failed, plan, n_classes, run_id, artifact)
