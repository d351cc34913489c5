"""The shape every trained model has: Spark ML parts, small parameters, and tables, saved and loaded alike.

Training frames have ``row_id``, ``features`` (vector) and ``label`` (double); class labels are 0..k-1.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class Context:
    """What an estimator may need to know, gathered once per training run."""

    n: int
    width: int
    classes: int = 0
    label_std: float = 1.0
    feature_variance: float = 1.0
    seed: int = 42
    budget: float = 1.0

    def scaled(self, amount: int, least: int = 2) -> int:
        """Trees, rounds or iterations under the training budget."""
        return max(least, int(round(amount * self.budget)))


@dataclass
class Fitted:
    kind: str
    parts: list = field(default_factory=list)
    params: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for models that have one, ``probability`` (array) or ``margin``."""
        return PREDICT[self.kind](self, df)

    @property
    def has_probability(self) -> bool:
        return bool(self.params.get("has_probability"))

    def save(self, spark: SparkSession, path: str) -> None:
        body = json.dumps({"kind": self.kind, "params": self.params, "tables": list(self.tables), "parts": len(self.parts)})
        spark.createDataFrame([(body,)], "body string").write.mode("overwrite").parquet(f"{path}/model")
        if self.parts:
            PipelineModel(stages=list(self.parts)).write().overwrite().save(f"{path}/parts")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/table_{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Fitted":
        body = json.loads(spark.read.parquet(f"{path}/model").first()["body"])
        parts = PipelineModel.load(f"{path}/parts").stages if body["parts"] else []
        tables = {t: spark.read.parquet(f"{path}/table_{t}") for t in body["tables"]}
        return cls(body["kind"], list(parts), body["params"], tables)


PREDICT: dict[str, Callable[[Fitted, DataFrame], DataFrame]] = {}
RESERVED = ["rawPrediction", "probability", "prediction", "margin"]


def predictor(kind: str):
    def add(fn):
        PREDICT[kind] = fn
        return fn

    return add


def context_of(df: DataFrame, classes: int = 0, seed: int = 42, budget: float = 1.0) -> Context:
    from pyspark.ml.stat import Summarizer

    row = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s"),
                 Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("f")).first()
    mean, var = row["f"]["mean"].toArray(), row["f"]["variance"].toArray()
    n = row["n"]
    overall = float((var * (n - 1) / max(1, n)).mean() + mean.var()) if len(var) else 1.0
    return Context(n, len(var), classes, row["s"] or 1.0, overall or 1.0, seed, budget)


@predictor("spark")
def _spark(model: Fitted, df: DataFrame) -> DataFrame:
    """A single Spark ML model."""
    out = model.parts[0].transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    return out.drop("rawPrediction")


@predictor("one_vs_rest")
def _one_vs_rest(model: Fitted, df: DataFrame) -> DataFrame:
    """One binary model per class; the class with the largest score wins."""
    out = df
    for i, part in enumerate(model.parts):
        column = "probability" if "probability" in [p.name for p in part.params] else "rawPrediction"
        out = part.transform(out).withColumn(f"_score{i}", vector_to_array(column)[1]).drop(*RESERVED)
    scores = F.array(*[F.col(f"_score{i}") for i in range(len(model.parts))])
    out = out.withColumn("_scores", scores)
    out = out.withColumn("prediction", (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double"))
    if model.has_probability:
        total = F.aggregate("_scores", F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform("_scores", lambda v: F.when(total > 0, v / total).otherwise(1.0 / len(model.parts))))
    return out.drop("_scores", *[f"_score{i}" for i in range(len(model.parts))])


def _words(a: np.ndarray) -> np.ndarray:
    """The bytes of each row as whole 64-bit words."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


def merged(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are equal become one with their summed weight. A hash brings them side by side; where it does not, they stay apart."""
    key = np.zeros(len(y), np.uint64)
    with np.errstate(over="ignore"):
        for word in (*_words(x).T, *_words(y[:, None]).T):
            key = (key ^ word) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    x, y, w = x[order], y[order], w[order]
    new = np.ones(len(y), bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])
    return x[new], y[new], np.add.reduceat(w, np.flatnonzero(new)) if len(w) else w


def merged_chunks(chunks: Iterator, room: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, label, weight) from chunks of (rows, label), equal rows merged ``room`` rows at a time.

    Where the first of them differ for the most part, the others pass as they come.
    """
    held, n, pays = [], 0, True
    for x, y in chunks:
        if not len(y):
            continue
        held.append((x, y, np.ones(len(y))))
        n += len(y)
        if pays and n < room:
            continue
        if pays:
            held = [merged(*[np.concatenate(part) for part in zip(*held)])]
            pays, n = 2 * len(held[0][1]) <= n, len(held[0][1])
        if 2 * n > room or not pays:
            yield tuple(np.concatenate(part) for part in zip(*held))
            held, n = [], 0
    if held:
        yield merged(*[np.concatenate(part) for part in zip(*held)])


def fit_spark(estimator, df: DataFrame) -> Fitted:
    model = estimator.fit(df)
    return Fitted("spark", [model], {"has_probability": model.hasParam("probabilityCol")})


def fit_one_vs_rest(make: Callable, df: DataFrame, classes: int, has_probability: bool) -> Fitted:
    """Train ``make()`` once per class on a 0/1 label."""
    parts = [make().fit(df.withColumn("label", (F.col("label") == float(c)).cast("double"))) for c in range(classes)]
    return Fitted("one_vs_rest", parts, {"has_probability": has_probability})
