"""Rows keep answers of their own, whatever they share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import training_frame
from gleanery.models.bank import CLASSIFIERS, REGRESSORS, spec
from gleanery.models.base import context_of
from gleanery.operators.features import Preprocessor
from gleanery.plans.analyze import ROW_ID, named_and_filled
from gleanery.plans.scoring import score_frame
from gleanery.streaming import jobs


def test_rows_that_differ_in_a_gap_have_names_of_their_own(spark):
    raw = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "x"), ("a", 1.0, None), ("a", 1.0, "x"), ("b", 1.0, "x"), ("b", 1.0, "x")], "k string, v double, s string")
    rows = named_and_filled(raw).collect()
    assert len(rows) == 4 and len({r[ROW_ID] for r in rows}) == 4
    assert all(r["v"] == 1.0 and r["s"] == "x" for r in rows)


@pytest.fixture(scope="module")
def line(spark):
    return training_frame(spark, np.arange(30.0)[:, None], np.arange(30.0) * 2)


def test_equal_names_get_their_own_neighbours(spark, line):
    asked = training_frame(spark, np.array([[0.0], [29.0], [29.0]]), np.zeros(3)).withColumn("row_id", F.lit("s")).drop("label")
    model = spec(REGRESSORS, "knn").train(line, context_of(line))
    got = sorted(r["prediction"] for r in model.transform(asked).collect())
    assert got == pytest.approx([6.0, 52.0, 52.0])
    classes = training_frame(spark, np.arange(30.0)[:, None], (np.arange(30.0) > 14).astype(float))
    model = spec(CLASSIFIERS, "knn").train(classes, context_of(classes, 2))
    got = sorted((r["prediction"], r["probability"]) for r in model.transform(asked.drop("row_id")).collect())
    assert got == [(0.0, [1.0, 0.0]), (1.0, [0.0, 1.0]), (1.0, [0.0, 1.0])]


@pytest.mark.parametrize("kept", [["who"], []])
def test_batches_and_streams_with_neighbours(spark, tmp_path, kept):
    records = spark.createDataFrame([("s", float(i)) for i in range(40)] + [("t", 3.0)], "who string, v double")
    prep = Preprocessor()
    features = prep.fit_transform(records.withColumn("y", F.col("v") * 2), "y", [], ["who"], ["who"])
    assert prep.feature_columns == ["v"]
    x = np.array([r["v"] for r in features.orderBy("v").collect()])
    frame = training_frame(spark, x[:, None], np.arange(len(x)).astype(float))
    model = spec(REGRESSORS, "knn").train(frame, context_of(frame))
    meta = {"problem_type": "regression"}
    batch = score_frame(records, model, prep, meta, kept)
    assert batch.columns == [*kept, "prediction", "score"]
    want = sorted(r["prediction"] for r in batch.collect())
    assert len(want) == 41 and len(set(want)) > 30
    records.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), records.schema, 1)
    jobs.stream_score(stream, model, prep, meta, str(tmp_path / "out"), str(tmp_path / "check"), kept).awaitTermination()
    assert sorted(r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
