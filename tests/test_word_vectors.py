"""Word vectors: association against brute force, factors against a full eigendecomposition, and the passes they take."""

from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.models import texts
from gleanery.models.texts import WINDOW, WordFront, association, factors


def test_association_counts_every_pair(spark):
    rng = np.random.default_rng(1)
    known = sorted(["ape", "bee", "cat", "dog", "eel"])
    rows = [" ".join(rng.choice([*known, "x1", "x2"], n)) for n in (0, 1, 2, 3, 9, 40, 41)] + [None]
    df = spark.createDataFrame([(r,) for r in rows], "text string").repartition(3)
    near = Counter()
    for row in rows:
        ids = [known.index(w) for w in (row or "").split() if w in known]
        for i, a in enumerate(ids):
            near[a, a] += 1
            for d in range(1, WINDOW + 1):
                if i + d < len(ids):
                    pair = a, ids[i + d]
                    for p in {pair, pair[::-1]}:
                        near[p] += WINDOW + 1 - d
    alone = {a: sum(v for (b, _), v in near.items() if b == a) for a in range(len(known))}
    total = sum(near.values())
    value = {p: log(v * total / (alone[p[0]] * alone[p[1]])) for p, v in near.items()}
    got = {(r["word"], r["other"]): r["value"] for r in association(df, "text", known).collect()}
    assert got == pytest.approx({p: v for p, v in value.items() if v > 0})


def test_factors_are_leading_eigenvectors(spark):
    rng = np.random.default_rng(2)
    base = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    m = (base * np.array([9.0, 7, 5, *rng.uniform(-0.2, 0.2, 27)])) @ base.T
    pairs = [(i, j, float(m[i, j])) for i in range(30) for j in range(30)]
    df = spark.createDataFrame(pairs, "word int, other int, value double").repartition(5)
    found = factors(df, 30, 3, 1, 8)
    best = (base[:, :3] * np.array([9.0, 7, 5])) @ base[:, :3].T
    assert np.allclose(found @ found.T, best, atol=1e-6)
    few = factors(df.filter("word < 2 and other < 2"), 2, 5, 1, 3)
    assert few.shape == (2, 5) and not few[:, 2:].any()


def test_texts_are_read_twice_whatever_the_rounds(spark):
    """Once for the vocabulary and once for the pairs; a round works on the pairs."""
    read = spark.sparkContext.accumulator(0)
    rows = [f"{'red green blue' if i % 2 else 'one two three'} w{i % 7}" for i in range(60)]

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame([(r,) for r in rows], "text string").select(seen.asNondeterministic()("text").alias("text"))
    front = WordFront("sequence", 4).fit(df, 1, 6)
    assert read.value <= 2 * len(rows)
    near = lambda a, b: np.dot(front.vectors[a], front.vectors[b])
    assert near("red", "green") > near("red", "two") and texts.MAX_VOCAB >= len(front.vectors) == 13
