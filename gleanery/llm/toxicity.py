"""Toxicity by class-conditional Kneser-Ney models of words."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import arrow_batch, small, texts_of

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Scoring:
    """``hinge``: how many nats above a text's usual log-likelihood ratio a word must lie to speak for a class; ``sample``: labelled rows
    that the calibration may hold; ``table``: words whose ratios every task holds, at 16 bytes each; the rarer words of a larger
    vocabulary are joined by word."""

    hinge: float = 2.0
    sample: int = 20_000
    table: int = 4_000_000


def expressions(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def class_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic_n, plain_n, contexts) of rows (text, toxic): tokens per class, and in how many texts of either class the
    word occurs, the shared counts that both models fall back to. Each task adds up its own first."""
    out = pa.schema([("word", pa.string()), ("n1", pa.int64()), ("n0", pa.int64()), ("contexts", pa.int64())])

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            words = list(counts)
            got = np.array(list(counts.values()), np.int64).reshape(-1, 3)
            counts.clear()
            for start in range(0, len(words), 50_000):
                yield arrow_batch(out, words[start:start + 50_000], *(got[start:start + 50_000, c] for c in range(3)))

        for part, texts in texts_of(batches):
            for text, toxic in zip(texts, part.column(1).to_pylist()):
                own: dict[str, int] = {}
                for w in expressions(text or ""):
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    row = counts.get(w)
                    if row is None:
                        row = counts[w] = [0, 0, 0]
                    row[0 if toxic else 1] += n
                    row[2] += 1
            if len(counts) > 300_000:
                yield from flush()
        yield from flush()

    rows = labelled.select("text", "toxic").mapInArrow(run, "word string, n1 long, n0 long, contexts long")
    return rows.groupBy("word").agg(F.sum("n1").alias("toxic_n"), F.sum("n0").alias("plain_n"), F.sum("contexts").alias("contexts"))


def _discounts(singles: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """What counts of one, two, and three or more give up to words not seen, from how often small counts occur."""
    y = singles / (singles + 2 * twos) if singles else 0.5
    got = [1 - 2 * y * twos / singles if singles else 0.5, 2 - 3 * y * threes / twos if twos else 1.0, 3 - 4 * y * fours / threes if threes else 1.5]
    return tuple(min(max(d, 0.1), k - 0.1) for d, k in zip(got, (1.0, 2.0, 3.0)))


@dataclass
class Ratios:
    """Log-likelihood ratio of each word by its hash, and of a word that neither class has seen.

    ``keys``, in ascending order, and ``values`` hold all words, or the most common ones if there are too many; then ``rest``
    has (key, value) of the others.
    """

    keys: np.ndarray
    values: np.ndarray
    unseen: float
    rest: DataFrame | None


def fit_ratios(counts: DataFrame, table: int) -> Ratios | None:
    """log p(word | toxic) - log p(word | ordinary) of every word, each class discounted and topped up from the shared
    distribution. None unless both classes have words."""
    steps = [1 << k for k in range(1, 62)]
    totals = counts.agg(
        F.sum("contexts").alias("contexts"), F.count(F.lit(1)).alias("words"), *[F.count_if(F.col("contexts") >= n).alias(f"from{n}") for n in steps],
        *[a for c in ("toxic_n", "plain_n") for a in (F.sum(c).alias(c), *[F.count_if(F.col(c) == k).alias(f"{c}{k}") for k in (1, 2, 3, 4)],
                                                       F.count_if(F.col(c) >= 3).alias(f"{c}_more"))]).first()
    if not totals["toxic_n"] or not totals["plain_n"]:
        return None
    shared = (F.col("contexts") + 0.5) / (totals["contexts"] + 0.5 * (totals["words"] + 1))

    def model(c: str) -> tuple[Column, float]:
        d = _discounts(*[totals[f"{c}{k}"] for k in (1, 2, 3, 4)])
        left = (d[0] * totals[f"{c}1"] + d[1] * totals[f"{c}2"] + d[2] * totals[f"{c}_more"]) / totals[c]
        off = F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
        return (F.col(c) - off) / totals[c] + left * shared, left

    (toxic, toxic_left), (plain, plain_left) = model("toxic_n"), model("plain_n")
    known = counts.select(F.xxhash64("word").alias("key"), F.log(toxic / plain).alias("value"), "contexts")
    least = 0 if totals["words"] <= table else next(n for n in steps if totals[f"from{n}"] <= table)
    rows = known.filter(F.col("contexts") >= least).select("key", "value").toArrow()
    keys, values = rows["key"].to_numpy(), rows["value"].to_numpy()
    order = np.argsort(keys, kind="stable")
    rest = known.filter(F.col("contexts") < least).select("key", "value") if least else None
    return Ratios(keys[order], values[order], math.log(toxic_left / plain_left), rest)


class _Lookup(dict):
    """(ratio, hash) of words, remembered up to a bound; the ratio of a word that is not in the table is not a number."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bound: int = 400_000):
        super().__init__()
        self.keys, self.values, self.bound = keys, values, bound

    def learn(self, words: set[str]) -> None:
        from xxhash import xxh64_intdigest

        if len(self) >= self.bound:
            self.clear()
        new = [w for w in words if w not in self]
        # The seed is that of Spark's function.
        keys = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in new], np.uint64).view(np.int64)
        got = np.full(len(new), np.nan)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            got = np.where(self.keys[at] == keys, self.values[at], np.nan)
        self.update(zip(new, zip(got.tolist(), keys.tolist())))


def evidence(values: np.ndarray, hinge: float) -> float:
    """The ratios above a text's median by more than ``hinge``, summed and divided by the root of its length.

    The median takes out what the language and topic of a text alone say about the class."""
    if not len(values):
        return 0.0
    middle = np.partition(values, len(values) // 2)[len(values) // 2]
    return float(np.maximum(values - middle - hinge, 0.0).sum()) / math.sqrt(len(values))


def evidence_of(docs: DataFrame, ratios: Ratios | None, hinge: float) -> DataFrame:
    """(doc_id, evidence) of every row."""
    if ratios is None:
        return docs.select("doc_id", F.lit(0.0).alias("evidence"))
    sent, unseen, whole = docs.sparkSession.sparkContext.broadcast((ratios.keys, ratios.values)), ratios.unseen, ratios.rest is None

    def looked_up(batches):
        """Each slice of rows, and per text the ratios and hashes of its words."""
        table = _Lookup(*sent.value)
        for part, texts in texts_of(batches):
            words = [expressions(t or "") for t in texts]
            table.learn({w for own in words for w in own})
            yield part, [np.array([table[w] for w in own], [("value", "f8"), ("key", "i8")]) for own in words]

    def run(batches):
        for part, found in looked_up(batches):
            got = [evidence(np.where(np.isnan(f["value"]), unseen, f["value"]), hinge) for f in found]
            yield pa.record_batch([part.column(0), pa.array(got, pa.float64())], names=["doc_id", "evidence"])

    if whole:
        return docs.mapInArrow(run, "doc_id long, evidence double")

    # Some words are beyond the table: each row asks for those it holds, once each with its count.
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("known", pa.list_(pa.float64())),
                        ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def ask(batches):
        for part, found in looked_up(batches):
            away = [np.unique(f["key"][np.isnan(f["value"])], return_counts=True) for f in found]
            yield arrow_batch(schema, part.column(0), part.column("row"), [f["value"][~np.isnan(f["value"])] for f in found],
                              [k for k, _ in away], [n for _, n in away])

    def answer(batches):
        for batch in batches:
            got = []
            for known, times, values, counts in zip(*(batch.column(c).to_pylist() for c in ("known", "times", "values", "counts"))):
                values, counts = values or [], counts or []
                missing = sum(times) - sum(counts)
                got.append(evidence(np.concatenate([known, np.repeat(np.array(values, float), np.array(counts, int)), np.full(missing, unseen)]), hinge))
            yield pa.record_batch([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "evidence"])

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    asked = cut(numbered.mapInArrow(ask, "doc_id long, row long, known array<double>, keys array<long>, times array<long>"))
    each = asked.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("n"))
    told = each.join(ratios.rest, "key").groupBy("row").agg(F.collect_list(F.struct("value", "n")).alias("told"))
    both = asked.join(told, "row", "left").select("doc_id", "known", "times", F.col("told.value").alias("values"), F.col("told.n").alias("counts"))
    return both.mapInArrow(answer, "doc_id long, evidence double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small penalty; no labelled rows or one class only give its share."""
    if not len(y) or y.min() == y.max():
        return (math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -5.0), 0.0
    design, b = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), max(0.0, float(b[1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: Column, calibrate: int = 4, how: Scoring = Scoring()) -> DataFrame:
    """(doc_id, score, predicted), one row for each input row, whole texts.

    ``labels`` has doc_id and toxic; ``fold`` numbers the documents; labels of fold 0 are never read, those of fold
    ``calibrate`` turn evidence into probabilities, the others train the two models. A null label is none; a document with
    several is toxic if one says so; labels of unknown documents are ignored. Null texts and texts without letters have
    the evidence 0 and its score. Without two labelled classes everything scores near 0. Repeated rows each come back; an
    empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = cut(marks.withColumn("fold", fold).filter("fold <> 0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = rows.join(small(marks.filter(F.col("fold") != calibrate).select("doc_id", "toxic")), "doc_id").select("text", "toxic")
    counts = cut(class_counts(learn))
    ratios = fit_ratios(counts, how.table)
    measured = cut(evidence_of(rows, ratios, how.hinge))
    held = measured.join(small(marks.filter(F.col("fold") == calibrate).select("doc_id", "toxic")), "doc_id")
    # A bounded sample by hash: one row per bucket.
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(how.sample))
    got = held.groupBy(bucket.alias("b")).agg(F.min(F.struct("doc_id", "evidence", "toxic")).alias("r")).select("r.evidence", "r.toxic").collect()
    base, slope = _logistic(np.array([r["evidence"] for r in got], float), np.array([r["toxic"] for r in got], float))
    score = 1 / (1 + F.exp(-(F.lit(base) + F.lit(slope) * F.col("evidence"))))
    return measured.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
