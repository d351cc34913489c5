"""Vocabulary, token ids and n-gram weights."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import counted, unigrams_and_bigrams, words
from ..session import cut, spread

PAD, UNK = "<pad>", "<unk>"
MAX_VOCAB = 15_000
MIN_VOCAB = 10
MAX_LEN = 128


def build_vocab(df: DataFrame, text: str, max_vocab: int = MAX_VOCAB) -> DataFrame:
    """(word, id, count): padding 0, unknown 1, then words by count and, on a tie, by spelling.

    Counts combine before the shuffle, the best words are taken as a distributed top-k, and only those
    (``max_vocab`` at most) are numbered in one task.
    """
    counts = spread(df.select(text)).select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    best = counts.orderBy(F.col("count").desc(), F.col("word").asc()).limit(max_vocab - 2)
    numbered = best.withColumn("id", (F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("word").asc())) + 1).cast("int"))
    special = df.sparkSession.createDataFrame([(PAD, 0, 0), (UNK, 0, 1)], "word string, count bigint, id int")
    return special.unionByName(numbered).select("word", "id", "count")


def vocab_map(vocab: DataFrame) -> dict[str, int]:
    """The vocabulary on the driver: at most ``MAX_VOCAB`` words."""
    return {r["word"]: r["id"] for r in vocab.collect()}


def encode_tokens(df: DataFrame, text: str, vocab: dict[str, int], max_len: int = MAX_LEN, out: str = "ids") -> DataFrame:
    """Fixed-length id arrays: unknown words 1, cut at ``max_len``, padded with 0. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("array<int>")
    def ids(tokens: pd.Series) -> pd.Series:
        known = shared.value
        return tokens.map(lambda ws: [known.get(w, 1) for w in ws])

    found = ids(F.slice(words(F.coalesce(F.col(text), F.lit(""))), 1, max_len))
    return spread(df).withColumn("_ids", found).withColumn(
        out, F.concat("_ids", F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_ids")))).drop("_ids")


def decode_tokens(df: DataFrame, ids: str, vocab: dict[str, int], out: str = "tokens") -> DataFrame:
    by_id = {i: w for w, i in vocab.items()}
    shared = df.sparkSession.sparkContext.broadcast([by_id.get(i, UNK) for i in range(max(by_id) + 1)])

    @F.pandas_udf("array<string>")
    def back(rows: pd.Series) -> pd.Series:
        table = shared.value
        return rows.map(lambda r: [table[i] if 0 <= i < len(table) else UNK for i in r])

    return df.withColumn(out, back(F.col(ids)))


# ---------------------------------------------------------------- n-gram weights

def ngram_terms(df: DataFrame, text: str, n_docs: int, max_features: int = 8000, min_df: int = 2) -> DataFrame:
    """The kept n-grams with their inverse document frequency; at most ``max_features`` rows.

    One shuffle by n-gram: a document counts its n-grams in its row, and emits each once with its count; they combine on the
    map side. Nothing is grouped by document.
    """
    grams = df.select(F.inline(counted(unigrams_and_bigrams(F.col(text)))))
    terms = grams.groupBy("gram").agg(F.sum("n").alias("corpus_count"), F.count(F.lit(1)).alias("df"))
    best = terms.filter(F.col("df") >= min_df).orderBy(F.col("corpus_count").desc(), F.col("gram").asc()).limit(max_features)
    return best.withColumn("idf", F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + 1.0)


def kept_terms(df: DataFrame, text: str, max_features: int = 8000, min_df: int = 2) -> DataFrame:
    """The vocabulary of ``ngram_tfidf`` (gram, idf), written once. Each of its n-grams has weights in ``min_df`` documents at least."""
    return cut(ngram_terms(spread(df.select(text)), text, df.count(), max_features, min_df).select("gram", "idf"))


def ngram_tfidf(df: DataFrame, doc: str, text: str, max_features: int = 8000, min_df: int = 2, terms: DataFrame | None = None) -> DataFrame:
    """Long form (doc, gram, tf, weight), L2-normalised per document.

    The kept n-grams are found first and broadcast, so only their occurrences are grouped by document. Who needs them
    besides may hand in ``kept_terms``.
    """
    rows = spread(df.select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    terms = kept_terms(df, text, max_features, min_df) if terms is None else terms
    occurrences = rows.select("doc", F.explode(unigrams_and_bigrams(F.col("text"))).alias("gram")).join(F.broadcast(terms), "gram")
    weighted = occurrences.groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf")).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))  # at most max_features rows each
    return weighted.select("doc", "gram", "tf", (F.col("raw") / norm).alias("weight"))


class NgramVectors:
    """The same weights as sparse vectors, row by row without a shuffle; for the text models."""

    def __init__(self, max_features: int = 8000, min_df: int = 2):
        self.max_features, self.min_df = max_features, min_df
        self.counter: CountVectorizerModel | None = None
        self.idf: list[float] = []

    @staticmethod
    def grams(text: str) -> Column:
        return unigrams_and_bigrams(F.coalesce(F.col(text), F.lit("")))

    def fit(self, df: DataFrame, text: str) -> "NgramVectors":
        """The best n-grams by count, then by spelling. They are counted in one shuffle that can spill; nothing is cached."""
        rows = spread(df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")))
        best = ngram_terms(rows, "_text", df.count(), self.max_features, self.min_df).orderBy(F.col("corpus_count").desc(), F.col("gram")).select("gram", "idf").collect()
        if not best:
            raise ValueError(f"no n-gram occurs in {self.min_df} texts")
        self.counter = CountVectorizerModel.from_vocabulary([r["gram"] for r in best], inputCol="_grams", outputCol="_tf")
        self.idf = [r["idf"] for r in best]
        return self

    def transform(self, df: DataFrame, text: str, out: str = "features") -> DataFrame:
        counted = self.counter.transform(df.withColumn("_grams", self.grams(text)))
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w").transform(counted)
        return Normalizer(p=2.0, inputCol="_w", outputCol=out).transform(weighed).drop("_grams", "_tf", "_w")
