"""Operators with a scalable path, against a brute-force answer, with the thresholds lowered to force that path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from gleanery.operators.knn import impute_knn, knn_classify, nearest
from gleanery.operators.lookup import lookup_join
from gleanery.operators.position import with_position
from gleanery.operators.quantiles import exact_quantiles
from gleanery.operators.split import ordered_split, stratified_folds


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.98, 1.0])
def test_quantiles_by_narrowing(spark, q):
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({
        "even": rng.uniform(-5, 5, n), "skewed": np.exp(rng.normal(0, 3, n)),
        "third": np.where(rng.uniform(size=n) < 0.34, 7.0, rng.normal(7, 1, n)), "few": rng.integers(0, 3, n).astype(float),
        "gaps": np.where(rng.uniform(size=n) < 0.5, None, rng.normal(size=n)).astype(float), "one": np.full(n, 4.0),
    })
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(7)
    got = exact_quantiles(df, list(pdf.columns), q, direct_rows=300)
    for c in pdf.columns:
        assert got[c] == pytest.approx(np.quantile(pdf[c].dropna(), q), rel=1e-12, abs=1e-12), c


def test_quantiles_of_nothing(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("v"))
    assert exact_quantiles(df, ["v"]) == {"v": None}


def test_position_with_a_hot_series_and_hot_ties(spark):
    n = 6000
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.when(F.col("id") % 2 == 0, 100).otherwise(F.pmod(F.xxhash64("id"), F.lit(500))).cast("long").alias("t")).repartition(9)
    got = with_position(df, "t", "id", ["k"], splits=16)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    assert got.count() == n
    assert got.join(want.select("id", "want"), "id").filter("position <> want").count() == 0


def test_position_without_keys(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("t"))
    got = with_position(df, "t", splits=8)
    assert got.filter(F.col("position") != F.col("t") + 1).count() == 0


def test_ordered_split_marks_the_first_share(spark):
    df = spark.range(103).select(F.col("id").alias("t"))
    out = ordered_split(df, "t").toPandas()
    assert out["is_train"].sum() == 82 and out[out.is_train]["t"].max() == 81


def test_lookup_join_split_into_hot_and_cold(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
                                  .otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"))
    facts = df.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("key") + F.col("n"))
    facts = facts.filter("key <> 'k7'")
    small = lookup_join(df, facts, "key", "n", ["v"], 1, 5000)
    large = lookup_join(df, facts, "key", "n", ["v"], 10**9, 5000)
    assert small.exceptAll(large).count() == 0 == large.exceptAll(small).count()
    assert large.count() == 5000


def _brute(train, queries, k):
    out = {}
    for qid, x in queries:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(t)) ** 2).sum())), tid) for tid, t in train)
        out[qid] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_nearest_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    # A third of the rows share one spot, the rest is spread out.
    x = np.vstack([np.full((150, 3), 0.5), rng.uniform(-10, 10, (300, 3))])
    train = [(i, row.tolist()) for i, row in enumerate(x)]
    queries = [(1000 + i, row.tolist()) for i, row in enumerate(rng.uniform(-10, 10, (60, 3)))]
    t = spark.createDataFrame([(i, v, float(i % 3)) for i, v in train], "id long, x array<double>, payload double")
    q = spark.createDataFrame(queries, "id long, x array<double>")
    got = nearest(t, q, 5, 3, block=block).toPandas()
    want = _brute(train, queries, 5)
    for qid, g in got.groupby("id"):
        assert g.sort_values("rank")["neighbour"].tolist() == want[qid]
    assert got["id"].nunique() == 60
    voted = knn_classify(t, q, 3, 5, block=block).toPandas().set_index("id")["prediction"]
    for qid, ids in want.items():
        votes = pd.Series([i % 3 for i in ids]).value_counts()
        assert voted[qid] == min(votes[votes == votes.max()].index)


@pytest.mark.parametrize("block", [16, 4096])
def test_impute_knn_by_hand(spark, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    x[rng.uniform(size=x.shape) < 0.15] = np.nan
    x[:, 3] = np.where(np.arange(200) < 3, 1.0, np.nan)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double").repartition(5)
    got = impute_knn(df, "k", ["a", "b", "c", "d"], 5, block).orderBy("k").toPandas()
    for i in range(200):
        for j, c in enumerate("abcd"):
            if not np.isnan(x[i, j]):
                assert got[c][i] == x[i, j]
                continue
            best = []
            for r in range(200):
                both = ~np.isnan(x[i]) & ~np.isnan(x[r])
                if not np.isnan(x[r, j]) and both.any():
                    best.append((np.sqrt(((x[i] - x[r])[both] ** 2).sum() * 4 / both.sum()), r))
            want = np.mean([x[r, j] for _, r in sorted(best)[:5]]) if best else np.nanmean(x[:, j])
            assert got[c][i] == pytest.approx(want), (i, c)


def test_stratified_folds_are_even_and_stable(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("y"))
    one = stratified_folds(df, "y", ["id"], 3)
    two = stratified_folds(df.repartition(13), "y", ["id"], 3)
    assert one.exceptAll(two).count() == 0
    sizes = one.groupBy("y").agg((F.max("fold") + 1).alias("k"), F.count(F.lit(1)).alias("n")).collect()
    per = one.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("gap")).collect()
    assert all(r["k"] == 3 for r in sizes) and all(r["gap"] <= 1 for r in per)
