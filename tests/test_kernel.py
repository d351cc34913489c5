"""Support vector regression over random features: the packed rounds against those of Spark's ridge."""

import numpy as np
import pytest
from conftest import training_frame
from pyspark.sql.classic.dataframe import DataFrame

from gleanery.models import linear
from gleanery.models.base import Context, context_of


def test_rounds_agree_with_lifted_rows_and_read_the_table_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    frame = training_frame(spark, x, np.sin(2 * x[:, 0]) * 5 + x[:, 1])
    ctx = context_of(frame)
    kernel = linear._kernel(ctx, 16)
    lifted = linear.with_random_features(frame.select("features", "label"), kernel).select("features", "label")
    wide = Context(ctx.n, 16, 0, ctx.label_std, 1.0, ctx.seed, 0.1)
    plane = linear.fit_linear_svr(lifted, wide, 0.1, 1.0).params["plane"]
    read, plain = [], DataFrame.select
    monkeypatch.setattr(DataFrame, "select", lambda self, *a: (read.append(a), plain(self, *a))[1])
    found = linear.fit_svr_rbf(frame, Context(**{**vars(ctx), "budget": 0.1}), size=160).params["inner_params"]["plane"]
    assert found == pytest.approx(plane, rel=1e-4, abs=1e-5)
    assert len(read) <= 2


def test_hinge_loss_is_that_of_lifted_rows_and_reads_the_table_once(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = (np.square(x).sum(axis=1) > 1.5).astype(float)
    frame = training_frame(spark, x, y)
    ctx = context_of(frame, 2)
    kernel = linear._kernel(ctx, 32)
    z, sign = linear.random_map(2, 32, kernel["gamma"], kernel["seed"])(x), 2 * y - 1
    loss = lambda plane: 0.5 * np.square(plane[:-1]).sum() + np.maximum(1 - sign * (z @ plane[:-1] + plane[-1]), 0).sum()
    lifted = linear.with_random_features(frame.select("features", "label"), kernel).select("features", "label")
    plain_model = LinearSVC(regParam=1.0 / ctx.n, standardization=False, maxIter=100).fit(lifted)
    read, plain = [], DataFrame.select
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "select", lambda self, *a: (read.append(a), plain(self, *a))[1])
        model = linear.fit_svm_rbf(frame, ctx, size=32)
    assert len(read) <= 2
    assert model.parts == []
    plane = np.array(model.params["inner_params"]["planes"][0])
    assert loss(plane) <= loss(np.append(plain_model.coefficients.toArray(), plain_model.intercept)) * 1.01
    rows = {r["row_id"]: r for r in model.transform(frame).collect()}
    told = z @ plane[:-1] + plane[-1]
    assert [rows[f"r{i:06d}"]["margin"] for i in range(600)] == pytest.approx(told, abs=1e-9)
    assert [rows[f"r{i:06d}"]["prediction"] for i in range(600)] == (told > 0).astype(float).tolist()


def test_several_classes_take_the_best_plane(spark, tmp_path):
    rng = np.random.default_rng(6)
    y = np.repeat([0.0, 1.0, 2.0], 60)
    x = rng.normal(size=(180, 2)) * 0.5 + np.array([[0, 0], [4, 0], [0, 4]])[y.astype(int)]
    frame = training_frame(spark, x, y)
    model = linear.fit_svm_rbf(frame, context_of(frame, 3), size=64)
    model.save(spark, str(tmp_path / "m"))
    again = linear.Fitted.load(spark, str(tmp_path / "m"))
    rows = again.transform(frame).select("label", "prediction").collect()
    assert np.mean([r["label"] == r["prediction"] for r in rows]) > 0.95
