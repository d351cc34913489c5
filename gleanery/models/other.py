"""Nearest neighbours and naive Bayes."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.knn import knn_classify, knn_regress
from ..session import cut
from .base import Context, Fitted, fit_spark, predictor


def fit_gaussian_nb(df: DataFrame, ctx: Context) -> Fitted:
    return fit_spark(NaiveBayes(modelType="gaussian", smoothing=0.0), df)


# ---------------------------------------------------------------- nearest neighbours

def fit_knn(df: DataFrame, ctx: Context, k: int = 7) -> Fitted:
    """The model is the training table itself."""
    table = cut(df.select(F.col("row_id").alias("id"), vector_to_array("features").alias("x"), F.col("label").alias("payload")))
    return Fitted("knn", [], {"has_probability": bool(ctx.classes), "classes": ctx.classes, "k": k, "width": ctx.width}, {"train": table})


@predictor("knn")
def _knn(model: Fitted, df: DataFrame) -> DataFrame:
    """Rows are written and numbered for the search, so rows that share every column, or have no name, keep answers of their own."""
    p = model.params
    keyed = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    queries = keyed.select(F.col("_id").alias("id"), vector_to_array("features").alias("x"))
    if not p["classes"]:
        found = knn_regress(model.tables["train"], queries, p["width"], p["k"]).select(F.col("id").alias("_found"), "prediction")
        return keyed.join(found, F.col("_id") == F.col("_found"), "left").drop("_found", "_id")
    found = knn_classify(model.tables["train"], queries, p["width"], p["k"])
    share = F.array(*[F.coalesce(F.element_at("votes", F.lit(float(c))), F.lit(0)) / F.lit(float(p["k"])) for c in range(p["classes"])])
    found = found.select(F.col("id").alias("_found"), "prediction", share.alias("probability"))
    return keyed.join(found, F.col("_id") == F.col("_found"), "left").drop("_found", "_id")


# ---------------------------------------------------------------- Spark's perceptrons, as saved before ``perceptron`` trained them

def _scaled_features(df: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    m, s = F.array(*[F.lit(float(v)) for v in mean]), F.array(*[F.lit(float(v)) for v in std])
    centred = F.zip_with(vector_to_array("features"), m, lambda a, b: a - b)
    return df.withColumn("_raw", F.col("features")).withColumn("features", array_to_vector(F.zip_with(centred, s, lambda a, b: a / b)))


@predictor("scaled")
def _scaled(model: Fitted, df: DataFrame) -> DataFrame:
    out = Fitted("spark", model.parts).transform(_scaled_features(df, model.params["mean"], model.params["std"]))
    return out.drop("features").withColumnRenamed("_raw", "features")
