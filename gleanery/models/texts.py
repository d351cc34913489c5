"""Text classifiers over one text column; word vectors also serve regressions (no classes in the context), by ridge regression."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.text import words
from ..operators.text import MAX_VOCAB, NgramVectors
from ..session import cut, spread
from .base import Context, Fitted, fit_one_vs_rest, fit_spark
from .linear import fit_least_squares
from .perceptron import fit_mlp_classifier


class TextModel:
    """A text column turned into ``features``, then an ordinary model. ``fit`` takes (text, label)."""

    def __init__(self, front, inner: Fitted):
        self.front, self.inner = front, inner

    @property
    def has_probability(self) -> bool:
        return self.inner.has_probability

    def transform(self, df: DataFrame) -> DataFrame:
        return self.inner.transform(self.front.transform(df, "text")).drop("features")

    def save(self, spark, path: str) -> None:
        self.inner.save(spark, path)
        self.front.save(spark, f"{path}/front")

    @classmethod
    def load(cls, spark, path: str) -> "TextModel":
        kind = json.loads(spark.read.parquet(f"{path}/front/kind").first()["body"])["kind"]
        front = NgramFront.load(spark, f"{path}/front") if kind == "ngrams" else WordFront.load(spark, f"{path}/front")
        return cls(front, Fitted.load(spark, path))


class NgramFront(NgramVectors):
    def save(self, spark, path: str) -> None:
        body = json.dumps({"kind": "ngrams", "max_features": self.max_features, "min_df": self.min_df, "idf": self.idf})
        spark.createDataFrame([(body,)], "body string").write.mode("overwrite").parquet(f"{path}/kind")
        PipelineModel(stages=[self.counter]).write().overwrite().save(f"{path}/counter")

    @classmethod
    def load(cls, spark, path: str) -> "NgramFront":
        body = json.loads(spark.read.parquet(f"{path}/kind").first()["body"])
        out = cls(body["max_features"], body["min_df"])
        out.idf, out.counter = body["idf"], PipelineModel.load(f"{path}/counter").stages[0]
        return out


def fit_ngram_model(df: DataFrame, ctx: Context, make, max_features: int = 8000) -> TextModel:
    front = NgramFront(max_features)
    front.fit(df, "text")
    # Vectors are written once: solvers and one-against-rest models read them again and again.
    ready = cut(front.transform(df, "text").select("features", "label"))
    return TextModel(front, make(ready, ctx))


def _logistic(ready: DataFrame, ctx: Context) -> Fitted:
    return fit_spark(LogisticRegression(regParam=1.0 / ctx.n, standardization=False, maxIter=ctx.scaled(2000, 20), tol=1e-5), ready)


def _linear_svc(ready: DataFrame, ctx: Context) -> Fitted:
    make = lambda: LinearSVC(regParam=1.0 / ctx.n, standardization=False, maxIter=ctx.scaled(200, 10), tol=1e-5)
    return fit_spark(make(), ready) if ctx.classes <= 2 else fit_one_vs_rest(make, ready, ctx.classes, False)


def _complement_nb(ready: DataFrame, ctx: Context) -> Fitted:
    return fit_spark(NaiveBayes(modelType="complement", smoothing=1.0), ready)


def _forest(ready: DataFrame, ctx: Context) -> Fitted:
    return fit_spark(RandomForestClassifier(numTrees=ctx.scaled(150, 5), maxDepth=max(4, ctx.scaled(20)), maxBins=16, seed=ctx.seed), ready)


def fit_tfidf_logistic(df, ctx):
    return fit_ngram_model(df, ctx, _logistic)


def fit_tfidf_linear_svc(df, ctx):
    return fit_ngram_model(df, ctx, _linear_svc)


def fit_tfidf_complement_nb(df, ctx):
    return fit_ngram_model(df, ctx, _complement_nb)


def fit_tfidf_random_forest(df, ctx):
    return fit_ngram_model(df, ctx, _forest, 5000)


# ---------------------------------------------------------------- word vectors

#: Words on either side that count as near.
WINDOW = 5


def _window_peaks(m: np.ndarray, sizes=(3, 4, 5)) -> np.ndarray:
    """For each window size, the largest window mean per coordinate over the whole text."""
    sums = np.vstack([np.zeros(m.shape[1]), np.cumsum(m, axis=0)])
    out = []
    for s in sizes:
        s = min(s, len(m))
        out.append(((sums[s:] - sums[:-s]) / s).max(axis=0) if len(m) else np.zeros(m.shape[1]))
    return np.concatenate(out)


def _both_ways(m: np.ndarray, decay: float = 0.97) -> np.ndarray:
    """Decayed averages that favour the end and the start of the text."""
    if not len(m):
        return np.zeros(2 * m.shape[1])
    age = np.arange(len(m))
    late, early = decay ** (len(m) - 1 - age), decay ** age
    return np.concatenate([late @ m / late.sum(), early @ m / early.sum()])


def association(df: DataFrame, text: str, known: list[str]) -> DataFrame:
    """(word, other, value), both ways round: how much more often two known words stand near each other than by chance, as positive
    pointwise mutual information, which is what skip-grams factorise (Levy and Goldberg 2014).

    All occurrences count, nearer ones for more. Unknown words are left out before distances are taken. A word is near itself, so words
    without company have a value too. Tasks sum pairs batch by batch, one shuffle adds them up.
    """
    n = len(known)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        table = pa.array(shared.value, pa.string())
        for batch in batches:
            tokens = batch.column(0)
            ids = pc.index_in(tokens.flatten(), value_set=table)
            kept = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            ids, rows = ids.fill_null(0).to_numpy(zero_copy_only=False)[kept].astype(np.int64), pc.list_parent_indices(tokens).to_numpy()[kept]
            for d in range(min(WINDOW, max(0, len(ids) - 1)) + 1):
                same = rows[d:] == rows[:len(rows) - d]
                one, two = ids[:len(ids) - d][same], ids[d:][same]
                pairs, times = np.unique(np.minimum(one, two) * n + np.maximum(one, two), return_counts=True)
                yield pa.record_batch([pa.array(pairs), pa.array(times * (WINDOW + 1 - d if d else 1))], names=["pair", "near"])

    tokens = spread(df.select(text)).select(words(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    counts = tokens.mapInArrow(run, "pair long, near long").groupBy("pair").agg(F.sum("near").alias("near"))
    half = cut(counts.select(F.floor(F.col("pair") / n).cast("int").alias("word"), (F.col("pair") % n).cast("int").alias("other"), "near"))
    both = half.unionByName(half.filter("word <> other").select(F.col("other").alias("word"), F.col("word").alias("other"), "near"))
    sums = both.groupBy("word").agg(F.sum("near").alias("all"))  # at most MAX_VOCAB rows
    total = sums.agg(F.sum("all").alias("t")).first()["t"]
    value = F.log(F.col("near") * F.lit(float(total)) / (F.col("a.all").cast("double") * F.col("b.all")))
    met = both.join(F.broadcast(sums.alias("a")), "word").join(F.broadcast(sums.select(F.col("word").alias("other"), "all").alias("b")), "other")
    return met.select("word", "other", value.alias("value")).filter("value > 0").repartition("word")


def factors(values: DataFrame, n: int, size: int, seed: int, rounds: int) -> np.ndarray:
    """Vectors of ``n`` words whose inner products come near the values: their leading eigenvectors, by orthogonal iteration.

    A round is one pass over the pairs, which are packed into blocks a single time; the driver holds a matrix of ``n`` by ``size``, so
    ``MAX_VOCAB`` rows at most.
    """
    context = values.sparkSession.sparkContext

    def pack(batches):
        for batch in batches:
            word, other, value = (batch.column(i).to_numpy() for i in range(3))
            if len(word):
                order = np.argsort(word, kind="stable")
                yield pa.record_batch([pa.array([v[order].tobytes()], pa.binary()) for v in (word, other, value)], names=["word", "other", "value"])

    blocks = cut(values.select("word", "other", "value").mapInArrow(pack, "word binary, other binary, value binary"))

    def times(q: np.ndarray) -> np.ndarray:
        shared, width = context.broadcast(q), q.shape[1]

        def run(batches):
            total = np.zeros((n, width))
            for row in (row for batch in batches for row in zip(*batch.columns)):
                word, other, value = (np.frombuffer(cell.as_buffer(), kind) for cell, kind in zip(row, (np.int32, np.int32, np.float64)))
                starts = np.flatnonzero(np.diff(word, prepend=-1))
                total[word[starts]] += np.add.reduceat(value[:, None] * shared.value[other], starts)
            found = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(found, pa.int32()), pa.array([r.tobytes() for r in total[found]], pa.binary())], names=["word", "sums"])

        rows = blocks.mapInArrow(run, "word int, sums binary").toArrow()
        out = np.zeros((n, width))
        np.add.at(out, rows["word"].to_numpy(), np.frombuffer(b"".join(rows["sums"].to_pylist())).reshape(-1, width))
        shared.unpersist()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, size))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    weight, turn = np.linalg.eigh(q.T @ times(q))
    out = np.zeros((n, size))
    out[:, :q.shape[1]] = (q @ turn) * np.sqrt(np.abs(weight))
    return out


class WordFront:
    """Word vectors pooled over the whole text, either by windows or in both directions."""

    def __init__(self, pooling: str, size: int = 64):
        self.pooling, self.size = pooling, size
        self.vectors: dict[str, list[float]] = {}

    def fit(self, df: DataFrame, seed: int, rounds: int) -> "WordFront":
        from ..operators.text import build_vocab

        known = sorted(r["word"] for r in build_vocab(df, "text").collect() if r["count"] > 0)
        if not known:
            raise ValueError("no text has a word")
        assert len(known) <= MAX_VOCAB
        vectors = factors(association(df, "text", known), len(known), self.size, seed, rounds)
        self.vectors = dict(zip(known, vectors.tolist()))
        return self

    def transform(self, df: DataFrame, text: str, out: str = "features") -> DataFrame:
        order = sorted(self.vectors)
        table = np.array([self.vectors[w] for w in order]) if order else np.zeros((0, self.size))
        shared = df.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(order)}, table))
        pool = _window_peaks if self.pooling == "windows" else _both_ways

        @F.pandas_udf("array<double>")
        def pooled(tokens: pd.Series) -> pd.Series:
            index, vectors = shared.value
            return tokens.map(lambda ws: pool(vectors[[index[w] for w in ws if w in index]]).tolist())

        return df.withColumn(out, array_to_vector(pooled(words(F.coalesce(F.col(text), F.lit(""))))))

    def save(self, spark, path: str) -> None:
        body = json.dumps({"kind": "words", "pooling": self.pooling, "size": self.size})
        spark.createDataFrame([(body,)], "body string").write.mode("overwrite").parquet(f"{path}/kind")
        spark.createDataFrame(list(self.vectors.items()), "word string, vector array<double>").write.mode("overwrite").parquet(f"{path}/words")

    @classmethod
    def load(cls, spark, path: str) -> "WordFront":
        body = json.loads(spark.read.parquet(f"{path}/kind").first()["body"])
        out = cls(body["pooling"], body["size"])
        out.vectors = {r["word"]: list(r["vector"]) for r in spark.read.parquet(f"{path}/words").collect()}
        return out


def _word_model(df: DataFrame, ctx: Context, pooling: str, size: int) -> TextModel:
    front = WordFront(pooling, max(8, ctx.scaled(size)))
    front.fit(df, ctx.seed, ctx.scaled(6, 1))
    ready = front.transform(df, "text")
    width = front.size * (3 if pooling == "windows" else 2)
    if not ctx.classes:
        # One pass over the texts, where gradient steps would take one pass each.
        return TextModel(front, fit_least_squares(ready, replace(ctx, width=width), l2=1.0 / ctx.n))
    # Texts are pooled once: scales and blocks read the written vectors.
    ready = cut(ready.select("features", "label"))
    return TextModel(front, fit_mlp_classifier(ready, replace(ctx, width=width), (64,), 200))


def fit_embed_windows(df: DataFrame, ctx: Context, size: int = 64) -> TextModel:
    """Convolution-like: means over windows of 3, 4 and 5 words, largest value kept."""
    return _word_model(df, ctx, "windows", size)


def fit_embed_sequence(df: DataFrame, ctx: Context, size: int = 64) -> TextModel:
    """Recurrent-like: a forward and a backward decayed state."""
    return _word_model(df, ctx, "sequence", size)
