"""Preprocessing, sources, sinks, scoring, streams and the whole analysis."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.dates import parse_date_text
from gleanery.functions.hashing import bucket_of
from gleanery.functions.types import nan_to_null
from gleanery.models.bank import CLASSIFIERS, REGRESSORS, spec
from gleanery.models.base import context_of
from gleanery.models.images import fit_image_classifier, image_features
from gleanery.operators import clean, infer
from gleanery.operators.features import Preprocessor
from gleanery.operators.monitor import check_drift, training_baseline
from gleanery.operators.profile import profile, profile_columns
from gleanery.operators.usecases import get_use_case, resolve_target
from gleanery.operators.scoring import positive_class_index
from gleanery.plans.analyze import run_analysis
from gleanery.plans.scoring import SeriesModelRefused, score_batch, score_frame
from gleanery.plans import training
from gleanery.session import fresh_path
from gleanery.sources import readers, sinks
from gleanery.streaming import jobs


def customers(spark, n=600):
    """Churn depends on tenure and contract; some cells are missing."""
    k = F.col("id")
    tenure = F.pmod(F.xxhash64("id"), F.lit(60)).cast("int")
    contract = F.when(k % 3 == 0, "Two year").when(k % 3 == 1, "One year").otherwise("Month-to-month")
    return spark.range(n).select(
        F.concat(F.lit("c"), k.cast("string")).alias("customer_id"), tenure.alias("tenure_months"), F.when(k % 17 != 0, (k % 90 + 20).cast("double")).alias("monthly_charges"),
        F.when(k % 13 != 0, contract).alias("contract_type"), F.concat(F.lit("town"), (k % 40).cast("string")).alias("town"),
        F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd").alias("signed"),
        F.when((tenure < 25) & (k % 3 == 2) | (tenure < 8), "Yes").otherwise("No").alias("Churn"))


# ---------------------------------------------------------------- profile and inference

def test_nan_is_missing_and_odd_columns_survive(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, None, None, True, "x"), (float("nan"), None, None, False, "x"), (3.0, None, None, True, None)],
                                           "a double, b double, s string, f boolean, `odd.name` string"))
    got = {r["column"]: r for r in profile(df).collect()}
    assert got["a"]["missing_count"] == 1 and got["a"]["mean"] == 2.0 and got["a"]["missing_pct"] == 33.33
    assert got["b"]["missing_count"] == 3 and got["b"]["mean"] is None and got["f"]["mean"] == pytest.approx(2 / 3)
    assert got["odd.name"]["top_values"][0]["value"] == "x" and got["s"]["unique_count"] == 0
    filled = clean.impute_auto(df).collect()
    assert [r["a"] for r in filled] == [1.0, 2.0, 3.0] and all(r["b"] is None and r["s"] == "Unknown" and r["odd.name"] == "x" for r in filled)
    sketch = {r["column"]: r["unique_count"] for r in profile_columns(df, approximate=True).collect()}
    assert sketch["a"] == 2


@pytest.mark.parametrize("text,want", [("2024-02-29", "2024-02-29 00:00:00"), ("2024-02-30", None), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
                                       ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("3/4/2020", "2020-03-04 00:00:00"), ("Mar 4, 2020", "2020-03-04 00:00:00"),
                                       ("1999", "1999-01-01 00:00:00"), ("12345", None), ("soon", None), ("2024-01-02 03:04:05.25", "2024-01-02 03:04:05.25")])
def test_date_texts(spark, text, want):
    got = spark.range(1).select(parse_date_text(F.lit(text)).cast("string").alias("d")).first()["d"]
    assert got == want


def test_target_rules(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 900).alias("many"), F.lit(1).alias("one"), (F.col("id") / 7).alias("ratio"),
                                  F.when(F.col("id") < 5, 1).alias("few"), (F.col("id") % 2).alias("y"), (F.col("id") % 600).alias("wide"))
    status = {r["column"]: r["status"] for r in infer.validate_target(df, df.columns + ["gone"]).collect()}
    assert status == {"row_id": "unique_identifier", "many": "too_many_values", "one": "single_value", "ratio": "unique_identifier", "few": "too_few_rows",
                      "y": "ok", "wide": "ok", "gone": "missing_column"}
    assert infer.validate_target(df, ["ratio"], allow_continuous=True).first()["status"] == "ok"
    assert infer.validate_target(df, ["wide"]).first()["many_values_warning"]
    assert infer.detect_problem_type(df, "y") == "classification" and infer.detect_problem_type(df, "ratio") == "regression"
    assert infer.detect_problem_type(df, None) == "clustering" and infer.detect_problem_type(df, "ratio", True) == "time_series"


# ---------------------------------------------------------------- preprocessing

def test_preprocessor_replays_after_saving(spark):
    df = customers(spark)
    prep = Preprocessor()
    prep.fit_transform(df, "Churn", ["signed"], ["customer_id"], ["customer_id"])
    path = fresh_path(spark, "prep")
    prep.save(spark, path)
    again = Preprocessor.load(spark, path)
    a, b = prep.transform(df, ["customer_id"]), again.transform(df.repartition(7), ["customer_id"])
    assert a.columns == ["customer_id", *prep.feature_columns]
    assert a.exceptAll(b).count() == 0 and a.count() == 600
    one = prep.transform(df.limit(1)).first().asDict()
    assert "contract_type_One year" in one and "contract_type_Month-to-month" not in one
    odd = prep.transform(df.limit(1).withColumn("contract_type", F.lit("Never seen")).withColumn("town", F.lit("nowhere")).withColumn("signed", F.lit("soon"))).first().asDict()
    assert all(v is not None for v in odd.values()) and odd["signed_year"] == 0 and odd["contract_type_Two year"] == 0
    with pytest.raises(ValueError, match="Missing columns"):
        prep.transform(df.drop("town"))


def test_out_of_fold_encoding_never_sees_its_own_fold(spark):
    df = customers(spark)
    got = Preprocessor().fit_transform(df, "Churn", ["signed"], ["customer_id"], ["customer_id"])
    raw = df.select("customer_id", "town", (F.col("Churn") == "Yes").cast("double").alias("y"), bucket_of(["customer_id"], 5).alias("fold")).toPandas()
    enc = {}
    for _, r in raw.iterrows():
        rest = raw[raw.fold != r.fold]
        mine = rest[rest.town == r.town]["y"]
        overall, between = rest["y"].mean(), rest["y"].var(ddof=0)
        if len(mine) == 0:
            enc[r.customer_id] = overall
            continue
        w = between * len(mine) / (between * len(mine) + mine.var(ddof=0))
        enc[r.customer_id] = w * mine.mean() + (1 - w) * overall
    values = np.array(list(enc.values()))
    want = {k: (v - values.mean()) / values.std() for k, v in enc.items()}
    for r in got.select("customer_id", "town").collect():
        assert r["town"] == pytest.approx(want[r["customer_id"]], abs=1e-9)


# ---------------------------------------------------------------- sources

def test_csv_types_tokens_and_line_breaks(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('i,d,b,s,blank,mixed\n1,1.5,True,"a ""q"", b",,1\n-2,NaN,False,"two\nlines",NA,x\nN/A,1e3,null,plain,,2\n')
    df = readers.scan_csv(spark, str(f))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "blank": "double", "mixed": "string"}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, -2, None] and [r["d"] for r in rows] == [1.5, None, 1000.0] and [r["b"] for r in rows] == [True, False, None]
    assert [r["s"] for r in rows] == ['a "q", b', "two\nlines", "plain"]


def test_records_must_have_the_required_columns(spark):
    lines = spark.createDataFrame([('{"a": 1, "c": "x"}',), ('{"a": 2}',)], "line string")
    assert [r.asDict() for r in readers.scan_records(lines, "line", "a int, c string", ["a", "c"]).collect()] == [{"a": 1, "c": "x"}, {"a": 2, "c": None}]
    with pytest.raises(ValueError, match="'b'"):
        readers.scan_records(lines, "line", "a int, b int", ["a", "b"])


def _png(path, colour, side=16):
    raw = b"".join(b"\x00" + bytes(colour) * side for _ in range(side))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_from_paths_to_classes(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(24):
        red = i % 2 == 0
        _png(tmp_path / f"p{i}.png", (200 + rng.integers(50), 20, 20) if red else (20, 20, 200 + rng.integers(50)))
        rows.append((str(tmp_path / f"p{i}.png"), float(red)))
    rows.append((str(tmp_path / "gone.png"), 1.0))
    df = spark.createDataFrame(rows, "picture string, label double")
    found = readers.scan_image_paths(df, "picture", str(tmp_path))
    assert found.count() == 24 and readers.scan_image_paths(df, "picture", str(tmp_path), least=25) is None
    feats = image_features(spark.read.format("image").load(str(tmp_path))).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    frame = found.withColumn("file", F.regexp_extract("picture", r"([^/]+)$", 1)).join(feats, "file").select(F.col("file").alias("row_id"), "features", "label")
    model = fit_image_classifier(frame, context_of(frame, 2, 42, 0.2))
    assert training._score(model.transform(frame), "classification") == 1.0


def test_images_are_told_apart_by_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("b/1.png", "top.png"):
        _png(tmp_path / name, (10, 20, 30))
    (tmp_path / "b" / "broken.png").write_text("no image")
    good = ["b/1.png", "./b/1.png", "1.png", f"{tmp_path}/b/1.png", "/other/machine/b/1.png", "C:/pictures/b/1.png", "top.png", "/elsewhere/top.png"]
    bad = ["a/1.png", "/other/a/1.png", "xb/1.png", "b/2.png", "a/top.png", "b/broken.png", "", None]
    rows = spark.createDataFrame([(p,) for p in good + bad], "picture string")
    found = readers.scan_image_paths(rows, "picture", str(tmp_path), least=1)
    assert sorted(r["picture"] for r in found.collect()) == sorted(good) and found.columns == ["picture"]


# ---------------------------------------------------------------- analysis, artifacts, scoring

@pytest.fixture(scope="module")
def analysis(spark):
    folder = fresh_path(spark, "flow")
    bank = [spec(CLASSIFIERS, n) for n in ("logistic_regression", "decision_tree", "linear_svc")]
    return folder, run_analysis(customers(spark), use_case_id="customer_churn", source="churn", bank=bank, folds=2, budget=0.1, trees=10, folder=folder)


def test_analysis_end_to_end(spark, analysis):
    folder, a = analysis
    assert a.problem_type == "classification" and a.target_status == "ok" and a.leakage == [] and a.n_classes == 2
    board = a.leaderboard.collect()
    assert len(board) == 2 and board[0]["test_score"] > 0.85 and a.best_name in ("logistic_regression", "decision_tree")
    sections = {r["section"] for r in a.explanation.select("section").distinct().collect()}
    assert sections - {"warning"} == {"metric", "confusion", "class_report", "importance", "class_label", "method"}
    said = {(r["section"], r["key"]): r["name"] for r in a.explanation.filter("section in ('class_label', 'method')").collect()}
    assert (said["class_label", "0"], said["class_label", "1"]) == ("No", "Yes")
    assert {v for k, v in said.items() if k[0] == "method"} == {a.best_name} and {k[1] for k in said if k[0] == "method"} <= {"shap", "permutation"}
    top = [r["name"] for r in a.explanation.filter("section = 'importance'").orderBy(F.desc("value")).collect()]
    assert "tenure_months" in top[:3]
    run = sinks.get_run(spark, f"{folder}/runs", a.run_id).first()
    assert run["metrics"]["n_rows"] == 600 and run["params"]["best_model"] == a.best_name and run["status"] == "FINISHED"
    assert sinks.latest_analysis(spark, f"{folder}/analyses")["run_id"] == a.run_id
    assert sinks.latest_analysis(spark, f"{folder}/nowhere") is None


def test_promotion_scoring_drift_and_stream(spark, analysis):
    folder, a = analysis
    with pytest.raises(PermissionError):
        sinks.promote_model(spark, a.artifact, f"{folder}/production", False)
    with pytest.raises(FileNotFoundError):
        sinks.promote_model(spark, f"{folder}/none", f"{folder}/production", True)
    sinks.promote_model(spark, a.artifact, f"{folder}/production", True, f"{folder}/versions")
    assert spark.read.parquet(f"{folder}/versions").count() == 1
    batch = customers(spark, 200).drop("Churn").withColumn("monthly_charges", F.lit(9999.0))
    scored, drift = score_batch(spark, f"{folder}/production", batch, ["customer_id"], sinks.load_baseline(spark, f"{folder}/baseline", "churn"))
    rows = scored.collect()
    assert len(rows) == 200 and {r["prediction"] for r in rows} <= {"Yes", "No"} and {r["risk_tier"] for r in rows} <= {"high", "medium", "low"}
    assert [r["column"] for r in drift.collect()] == ["monthly_charges"]
    with pytest.raises(ValueError, match="Missing columns"):
        score_batch(spark, f"{folder}/production", batch.drop("town"), ["customer_id"])
    model, prep, meta = sinks.load_artifact(spark, f"{folder}/production")
    with pytest.raises(SeriesModelRefused):
        score_frame(batch, model, prep, {**meta, "problem_type": "time_series"}, ["customer_id"])
    batch.repartition(6).write.parquet(f"{folder}/incoming")
    stream = jobs.read_stream(spark, f"{folder}/incoming", batch.schema, max_files=2)
    jobs.stream_score(stream, model, prep, meta, f"{folder}/out", f"{folder}/state", ["customer_id"]).awaitTermination()
    assert spark.read.parquet(f"{folder}/out").exceptAll(scored).count() == 0 and spark.read.parquet(f"{folder}/out").count() == 200
    base = sinks.load_baseline(spark, f"{folder}/baseline", "churn")
    jobs.stream_score(stream, model, prep, meta, f"{folder}/out2", f"{folder}/state2", ["customer_id"], f"{folder}/log2", base).awaitTermination()
    assert spark.read.parquet(f"{folder}/out2").drop("epoch").exceptAll(scored).count() == 0 and spark.read.parquet(f"{folder}/log2/predictions").count() == 200
    assert spark.read.parquet(f"{folder}/log2/batches").agg(F.sum("n_records")).first()[0] == 200
    assert {r["column"] for r in spark.read.parquet(f"{folder}/log2/drift").collect()} >= {"monthly_charges"}
    with pytest.raises(ValueError, match="log folder"):
        jobs.stream_score(stream, model, prep, meta, f"{folder}/out3", f"{folder}/state3", ["customer_id"], baseline=base)
    sinks.log_predictions(scored.join(batch, "customer_id"), f"{folder}/log", "prediction", ["tenure_months", "town"], "b1")
    entry = spark.read.parquet(f"{folder}/log/batches").first()
    assert entry["n_records"] == 200 and list(entry["input_means"]) == ["tenure_months"] and spark.read.parquet(f"{folder}/log/predictions").count() == 200


def test_stream_drift_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, value double"
    base = training_baseline(spark.createDataFrame([(float(v),) for v in range(10)], "value double"))
    source = str(tmp_path / "in")
    moments = [[datetime(2024, 1, 1, 5), datetime(2024, 1, 2, 5)], [datetime(2024, 1, 4, 5)], [datetime(2024, 1, 1, 6), datetime(2024, 1, 5, 5)]]
    for part in moments:
        spark.createDataFrame([(t, 100.0) for t in part], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_drift(jobs.read_stream(spark, source, spark.createDataFrame([], schema).schema), base, "ts", ["value"],
                          str(tmp_path / "out"), str(tmp_path / "state"), width="1 day", late="1 hour").awaitTermination()
    got = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-04": 1}
    assert spark.read.parquet(str(tmp_path / "out")).filter("not is_drift").count() == 0


def test_regression_clusters_and_series(spark):
    rows = customers(spark, 400).drop("Churn", "signed").withColumn("spend", F.col("tenure_months") * 3.0 + F.rand(1))
    a = run_analysis(rows, "spend", bank=[spec(REGRESSORS, "linear_regression"), spec(REGRESSORS, "decision_tree")], folds=2, budget=0.2, trees=5,
                     id_columns=["customer_id"], allow_continuous=True)
    assert a.problem_type == "regression" and a.best_name == "linear_regression" and a.leaderboard.first()["test_score"] > 0.95
    assert a.leakage == ["tenure_months"]
    c = run_analysis(rows.drop("spend"), trees=5, id_columns=["customer_id"], cluster_options={"ks": [2], "starts": 1, "methods": []})
    assert c.problem_type == "clustering" and c.explanation.filter("section = 'cluster_profile'").count() > 0
    days = spark.range(120).select(F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") * 2.0 + F.sin(F.col("id"))).alias("sales"))
    s = run_analysis(days, "sales", trees=5, allow_continuous=True)
    assert s.problem_type == "time_series" and s.leaderboard.count() == 3
    with pytest.raises(ValueError, match="unique_identifier"):
        run_analysis(rows, "customer_id", trees=5)


def test_templates():
    assert resolve_target(None, "loan_default") == "Default" and resolve_target("mine", "loan_default") == "mine" and resolve_target(None, "zzz") is None
    assert get_use_case("zzz") is None and positive_class_index(["No", "Yes"], "customer_churn") == 1
    assert positive_class_index(["0", "1"], "customer_churn") == 1 and positive_class_index(["a"], "customer_churn") == 0
    assert positive_class_index(["No", "Yes"], None) is None and positive_class_index(["No", "Yes"], "customer_churn", "regression") is None
    assert sinks.report_name("fraud_detection", datetime(2024, 1, 2, 3, 4, 5)) == "fraud_alert_report_20240102_030405.csv"
    assert sinks.report_name(None, datetime(2024, 1, 2, 3, 4, 5)).startswith("prediction_report_")


def test_drift_message(spark):
    base = training_baseline(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, flat double"))
    assert [r["column"] for r in base.collect()] == ["a"]
    out = check_drift(spark.createDataFrame([(9.0,), (9.5,)], "a double"), base).first()
    assert out["warning"] == "a: incoming mean 9.250 deviates 7.2σ from training (2.000)" or out["warning"].startswith("a: incoming mean 9.250 deviates 7.")
    assert check_drift(spark.createDataFrame([(2.5,)], "a double"), base).count() == 0
    assert check_drift(spark.createDataFrame([], "a double"), base).count() == 0


def test_text_analysis_names_the_words(spark):
    rng = np.random.default_rng(0)
    topics = [["invoice", "refund", "billing", "payment"], ["crash", "error", "bug", "freeze"]]
    rows = [(i, " ".join(rng.choice(topics[i % 2], 9)) + f" ticket number{i}", i % 5, "money" if i % 2 == 0 else "defect") for i in range(120)]
    df = spark.createDataFrame(rows, "ticket_id long, body string, level long, kind string")
    a = run_analysis(df, "kind", bank=[spec(CLASSIFIERS, "gaussian_nb")], folds=2, budget=0.1, trees=5, id_columns=["ticket_id"])
    names = {r["model"] for r in a.leaderboard.collect()}
    assert {"gaussian_nb", "tfidf_logistic", "embed_windows", "embed_sequence"} <= names
    assert a.leaderboard.first()["test_score"] >= 0.95
    if a.best_name in ("tfidf_logistic", "tfidf_linear_svc"):
        words = {r["name"] for r in a.explanation.filter("section = 'text_tokens'").collect()}
        assert words & {w for t in topics for w in t}
    scored, _ = score_batch(spark, a.artifact, df.drop("kind"), ["ticket_id"])
    assert scored.join(df, "ticket_id").filter("prediction = kind").count() >= 110


def test_regression_with_text_gets_sequence_models(spark):
    rng = np.random.default_rng(1)
    topics = [["cheap", "small", "plain", "used"], ["luxury", "large", "golden", "new"]]
    rows = [(i, " ".join(rng.choice(topics[i % 2], 9)) + f" item number{i}", float(rng.normal()), 10.0 * (i % 2) + float(rng.normal()) * 0.3) for i in range(160)]
    df = spark.createDataFrame(rows, "item_id long, body string, noise double, price double")
    a = run_analysis(df, "price", bank=[spec(REGRESSORS, "linear_regression")], folds=2, budget=0.4, trees=5, id_columns=["item_id"], allow_continuous=True)
    board = {r["model"]: r for r in a.leaderboard.collect()}
    assert set(board) == {"linear_regression", "embed_windows", "embed_sequence"} and a.problem_type == "regression"
    assert a.best_name.startswith("embed_") and board[a.best_name]["test_score"] > 0.8
    scored, _ = score_batch(spark, a.artifact, df.drop("price"), ["item_id"])
    assert scored.join(df, "item_id").filter("abs(prediction - price) < 5").count() >= 150
