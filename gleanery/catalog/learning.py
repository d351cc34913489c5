"""Training, comparing, explaining and scoring models with the presets of the library, on rules planted in the tables."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window, functions as F

from ..functions.hashing import bucket_of
from ..models import cluster as cl
from ..models import series as ts
from ..models.base import context_of
from ..models.bank import CLASSIFIERS, REGRESSORS, TEXT_CLASSIFIERS, TEXT_SEQUENCE, spec
from ..operators import explain as ex
from ..operators import knn
from ..operators.features import Preprocessor
from ..operators.split import train_test_split
from ..operators.usecases import get_use_case
from ..plans import training
from ..plans.analyze import run_analysis
from ..plans.scoring import score_batch as score_with
from ..session import cut, fresh_path, keep, spread
from ..sources import sinks
from ..streaming import jobs
from .registry import LINE_KEYS, lines_with_key, query, table, token_sql


def _frame(df, names, label, key):
    ready = spread(df).select(F.col(key).cast("string").alias("row_id"), label.cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in names])
    return VectorAssembler(inputCols=names, outputCol="features").transform(ready).select("row_id", "features", "label")


ORDER_FEATURES = ["price", "late", "weekday", "customer"]


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("price"), (F.month("o_orderdate") >= 7).cast("double").alias("late"),
                    F.weekday("o_orderdate").alias("weekday"), (F.col("o_custkey") % 100 / 100).alias("customer"))


def _binary(spark, sf):
    """Dear for its season? Price and season decide; weekday and customer say nothing."""
    return _frame(_orders(spark, sf), ORDER_FEATURES, F.col("price") > 2.2 + 0.8 * F.col("late"), "o_orderkey")


def _scored(spark, sf):
    """A number that customer and season determine."""
    return _frame(_orders(spark, sf), ["late", "weekday", "customer"], 10 * F.col("customer") + 5 * F.col("late"), "o_orderkey")


#: From this accuracy or R2 on held-out rows on, a model has found the planted rule.
FOUND = 0.9
_HELD_OUT = f"{token_sql('o_orderkey', seed=42)} % 5 = 0"


def _rule_sql(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS model, count(*) AS n, count(*) AS n_predicted, true AS found_rule FROM {rows}"


def _judge_rule(spec_, model, test, problem_type):
    predicted = keep(model.transform(test))
    n = predicted.agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("n_predicted"))
    value = training._score(predicted, problem_type)
    return n.select(F.lit(spec_.name).alias("model"), "n", "n_predicted", F.lit(float(value) >= FOUND).alias("found_rule"))


def _register(prefix: str, key: str, name: str, bank, data, problem_type: str, classes: int):
    @query(f"{prefix}_{key}", _rule_sql(name, f"orders WHERE {_HELD_OUT}"))
    def run(spark, sf):
        train, test = train_test_split(data(spark, sf), ["row_id"], 42)
        train = keep(train)
        s = spec(bank, name)
        return _judge_rule(s, s.train(train, context_of(train, classes)), test, problem_type)


for _key, _name in {"logistic": "logistic_regression", "ridge_logistic": "ridge_classifier", "linear_svc": "linear_svc", "svm_rbf": "svm_rbf", "decision_tree": "decision_tree",
                    "random_forest": "random_forest", "extra_trees": "extra_trees", "gradient_boosting": "gradient_boosting", "ada_boost": "ada_boost",
                    "xgb_style": "xgboost", "lgbm_style": "lightgbm", "catboost_style": "catboost", "mlp": "mlp_ann"}.items():
    _register("clf", _key, _name, CLASSIFIERS, _binary, "classification", 2)

for _key, _name in {"linear_svr": "linear_svr", "svr_rbf": "svr_rbf", "decision_tree": "decision_tree", "random_forest": "random_forest", "extra_trees": "extra_trees",
                    "gradient_boosting": "gradient_boosting", "ada_boost": "ada_boost", "xgb_style": "xgboost", "lgbm_style": "lightgbm", "catboost_style": "catboost", "mlp": "mlp_ann"}.items():
    _register("reg", _key, _name, REGRESSORS, _scored, "regression", 0)


# ---------------------------------------------------------------- models with a closed form, checked by SQL

def _quantity(spark, sf):
    lines = lines_with_key(spark, sf).withColumn("y", F.col("l_extendedprice") / 1000)
    frame = lines.withColumn("key", F.concat_ws("|", *LINE_KEYS))
    return keep(_frame(frame, ["l_quantity"], F.col("y"), "key"))


_MOMENTS = "(SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(y, x) AS cxy, count(*) AS n FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem))"


def _line_sql(slope: str) -> str:
    return f"SELECT round(slope, 6) AS slope, round(my - slope * mx, 4) AS intercept FROM (SELECT mx, my, {slope} AS slope FROM {_MOMENTS})"


def _line(spark, sf, name):
    frame = _quantity(spark, sf)
    model = spec(REGRESSORS, name).train(frame, context_of(frame)).parts[0]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6), round(float(model.intercept), 4))], "slope double, intercept double")


@query("reg_linear", _line_sql("cxy / vx"))
def reg_linear(spark, sf):
    return _line(spark, sf, "linear_regression")


@query("reg_ridge", _line_sql("cxy * n / (vx * n + 1)"))
def reg_ridge(spark, sf):
    return _line(spark, sf, "ridge")


@query("reg_lasso", _line_sql("sign(cxy) * greatest(abs(cxy) - 1, 0) / vx"))
def reg_lasso(spark, sf):
    return _line(spark, sf, "lasso")


@query("reg_elastic_net", _line_sql("sign(cxy) * greatest(abs(cxy) - 0.5, 0) / (vx + 0.5)"))
def reg_elastic_net(spark, sf):
    return _line(spark, sf, "elastic_net")


_NB = """(SELECT CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label, l_quantity, l_extendedprice / 1000 AS price, l_discount * 100 AS discount, l_tax * 100 AS tax FROM lineitem)"""


@query("clf_gaussian_nb", " UNION ALL ".join(f"SELECT CAST(label AS INT) AS class, '{c}' AS feature, round(avg({c}), 4) AS mean, round(var_pop({c}), 3) AS variance, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS prior FROM {_NB} GROUP BY label"
                                          for c in ("l_quantity", "price", "discount", "tax")))
def clf_gaussian_nb(spark, sf):
    lines = lines_with_key(spark, sf).select(F.concat_ws("|", *LINE_KEYS).alias("key"), "l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"),
                                             (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"))
    names = ["l_quantity", "price", "discount", "tax"]
    label = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    frame = keep(_frame(lines, names, label, "key"))
    model = spec(CLASSIFIERS, "gaussian_nb").train(frame, context_of(frame, 3)).parts[0]
    rows = [(c, f, round(float(model.theta[c, i]), 4), round(float(model.sigma[c, i]), 3), round(math.exp(model.pi[c]), 6)) for c in range(3) for i, f in enumerate(names)]
    return spark.createDataFrame(rows, "class int, feature string, mean double, variance double, prior double")


_SPLIT = f"(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, {token_sql('vec_id', seed=42)} % 5 = 0 AS is_test FROM embeddings)"
_NEAR = f"""(SELECT * FROM (SELECT q.vec_id, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, r.x), r.vec_id) AS n
  FROM {_SPLIT} q JOIN {_SPLIT} r ON q.is_test AND NOT r.is_test) WHERE n <= 7)"""


def _neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("payload"))
    train, test = train_test_split(e, ["id"], 42)
    return train, test.select("id", "x")


@query("clf_knn", f"SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM (SELECT vec_id, label, count(*) AS c FROM {_NEAR} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1")
def clf_knn(spark, sf):
    train, test = _neighbours(spark, sf)
    return knn.knn_classify(train, test, 64, 7).select(F.col("id").alias("vec_id"), "prediction")


@query("reg_knn", f"SELECT vec_id, round(avg(label), 6) AS prediction FROM {_NEAR} GROUP BY vec_id")
def reg_knn(spark, sf):
    train, test = _neighbours(spark, sf)
    return knn.knn_regress(train, test, 64, 7).select(F.col("id").alias("vec_id"), F.round("prediction", 6).alias("prediction"))


# ---------------------------------------------------------------- text

def _languages(spark, sf):
    d = table(spark, sf, "documents")
    classes = [r["lang"] for r in d.select("lang").distinct().orderBy("lang").collect()]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("lang")) - 1
    return spread(d).select(F.col("doc_id").cast("string").alias("row_id"), "text", label.cast("double").alias("label")), len(classes)


def _register_text(key: str, name: str, bank):
    @query(f"txt_{key}", _rule_sql(name, f"documents WHERE {token_sql('doc_id', seed=42)} % 5 = 0"))
    def run(spark, sf):
        frame, classes = _languages(spark, sf)
        train, test = train_test_split(frame, ["row_id"], 42)
        train = keep(train)
        s = spec(bank, name)
        return _judge_rule(s, s.train(train, training.Context(train.count(), 0, classes)), test, "classification")


for _key in ("tfidf_logistic", "tfidf_linear_svc", "tfidf_complement_nb", "tfidf_random_forest"):
    _register_text(_key, _key, TEXT_CLASSIFIERS)
_register_text("embed_cnn", "embed_windows", TEXT_SEQUENCE)
_register_text("embed_seq", "embed_sequence", TEXT_SEQUENCE)


# ---------------------------------------------------------------- clusters

def _part_points(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("row_id"), F.array((F.col("p_size") / 50).cast("double"), (F.col("p_retailprice") / 1000).cast("double")).alias("x"))


def _planted_points(spark, sf):
    """The same points in three groups far apart, by part number."""
    part = F.col("row_id").cast("long") % 3
    moved = F.array(F.col("x")[0] + F.when(part == 1, 10.0).otherwise(0.0), F.col("x")[1] + F.when(part == 2, 10.0).otherwise(0.0))
    return _part_points(spark, sf).withColumn("x", moved)


def _grouped(assigned, name):
    """Every row with the smallest row of its cluster."""
    key = F.col("row_id").cast("long")
    least = assigned.groupBy("cluster").agg(F.min(key).alias("first_of_cluster"))
    return assigned.join(least, "cluster").select(F.lit(name).alias("model"), key.alias("p_partkey"), "first_of_cluster")


def _planted_sql(name: str) -> str:
    return f"SELECT '{name}' AS model, p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey % 3) AS first_of_cluster FROM part"


@query("clu_kmeans_sweep", "SELECT 'kmeans_k' || k AS model, true AS separated FROM range(2, (SELECT least(10, greatest(3, count(*) // 5)) FROM part)) t(k)")
def clu_kmeans_sweep(spark, sf):
    points = _part_points(spark, sf).select("row_id", F.col("x")[0].alias("size"), F.col("x")[1].alias("price"))
    board = training.train_clusters(points, ["size", "price"], "row_id", methods=[]).leaderboard
    return board.select("model", (F.col("silhouette_score") > 0.2).alias("separated"))


@query("clu_agglomerative", _planted_sql("agglomerative"))
def clu_agglomerative(spark, sf):
    return _grouped(cl.fit_agglomerative(_planted_points(spark, sf), 3), "agglomerative")


@query("clu_gaussian_mixture", _planted_sql("gaussian_mixture"))
def clu_gaussian_mixture(spark, sf):
    return _grouped(cl.fit_gaussian_mixture(_planted_points(spark, sf), 3), "gaussian_mixture")


@query("clu_birch", _planted_sql("birch"))
def clu_birch(spark, sf):
    return _grouped(cl.fit_birch(_planted_points(spark, sf), 2, 3, 0.05), "birch")


_POINTS = "(SELECT p_partkey, p_size / 50.0::DOUBLE AS a, p_retailprice / 1000 AS b FROM part)"
_CORE = f"(SELECT q.p_partkey, q.a, q.b, count(*) >= 5 AS is_core FROM {_POINTS} q JOIN {_POINTS} r ON (q.a - r.a) * (q.a - r.a) + (q.b - r.b) * (q.b - r.b) <= 0.03 * 0.03::DOUBLE GROUP BY ALL)"


@query("clu_dbscan", f"""SELECT c.p_partkey, c.is_core, NOT c.is_core AND NOT EXISTS (SELECT 1 FROM {_CORE} k WHERE k.is_core AND (c.a - k.a) * (c.a - k.a) + (c.b - k.b) * (c.b - k.b) <= 0.03 * 0.03::DOUBLE) AS is_noise
  FROM {_CORE} c""".replace("0.03 * 0.03::DOUBLE", "0.0009::DOUBLE"))
def clu_dbscan(spark, sf):
    points = keep(_part_points(spark, sf))
    core = cl.core_points(points, 2, 0.03, 5).select("x", "is_core")
    labels = cl.fit_dbscan(points, 2, 0.03, 5)
    return labels.join(core, "x").select(F.col("row_id").cast("long").alias("p_partkey"), "is_core", (F.col("cluster") == -1).alias("is_noise"))


# ---------------------------------------------------------------- series

def _daily(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("y"))


def _risen(spark, sf):
    """The same series on a level that rises by 5,000 over the first 60% of the time and stays: the mean of the past says nothing."""
    daily = _daily(spark, sf).withColumn("at", F.unix_timestamp(F.col("hour").cast("timestamp")))
    ends = daily.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    way = (F.col("at") - ends["a"]) / (0.6 * (ends["b"] - ends["a"]))
    return daily.select("event_type", "hour", (F.col("y") + 5000 * F.least(way, F.lit(1.0))).alias("y"))


@query("ts_arima", """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t, avg(value) AS y FROM events GROUP BY ALL)
  SELECT event_type AS series, m.model, CAST(count(*) - floor(0.8 * count(*)) AS BIGINT) AS n_test, true AS sound
  FROM h CROSS JOIN (VALUES ('ARIMA(1,1,1)'), ('ARIMA(2,1,1)'), ('ARIMA(1,1,2)')) m(model) GROUP BY ALL""")
def ts_arima(spark, sf):
    """Every hour after the first four fifths has a forecast, with a mean error below 600; the mean of the past is off by 1,800."""
    f = ts.arima_forecasts(_risen(spark, sf), "hour", "y", "event_type")
    return f.groupBy("series", "model").agg(F.count("forecast").alias("n_test"), (F.avg(F.abs(F.col("forecast") - F.col("actual"))) < 600).alias("sound"))


# ---------------------------------------------------------------- explanation

def _forest(spark, sf):
    train, test = train_test_split(_binary(spark, sf), ["row_id"], 42)
    train = keep(train)
    return spec(CLASSIFIERS, "random_forest").train(train, context_of(train, 2)), test


_ADDS_UP_SQL = f"SELECT o_orderkey, true AS adds_up FROM orders WHERE {_HELD_OUT}"
_MATTERS_SQL = "SELECT * FROM (VALUES ('price', true), ('late', true), ('weekday', false), ('customer', false)) t(feature, matters)"


def _adds_up(values, model, test, base):
    """Per row: do the values and the base sum to the model's output?"""
    said = model.transform(test).select(F.col("row_id").alias("row"), F.col("probability")[1].alias("said"))
    sums = values.groupBy("row").agg(F.sum("value").alias("total"))
    gap = F.abs(F.col("total") + base - F.col("said"))
    return said.join(sums, "row", "left").select(F.col("row").cast("long").alias("o_orderkey"), F.coalesce(gap < 1e-6, F.lit(False)).alias("adds_up"))


@query("shap_tree", _ADDS_UP_SQL)
def shap_tree(spark, sf):
    model, test = _forest(spark, sf)
    values = keep(ex.shap_tree(test, model))
    base = values.select(F.col("base")[1].alias("b")).first()["b"]
    return _adds_up(ex.shap_long(values, ORDER_FEATURES).filter("class = 1"), model, test, F.lit(base))


@query("shap_sampled", _ADDS_UP_SQL)
def shap_sampled(spark, sf):
    """Fifty background rows, and fifty orders of the features, for every held-out row."""
    model, test = _forest(spark, sf)
    drawn = test.select("row_id", "features", F.xxhash64("row_id").alias("h")).orderBy("h", "row_id").limit(50)
    background = [r["x"] for r in drawn.select(vector_to_array("features").alias("x")).collect()]
    score = lambda d: model.transform(d).withColumn("y", F.col("probability")[1])
    values = ex.shap_sampled(test, score, "y", ORDER_FEATURES, background, rounds=len(background))
    base = score(spark.createDataFrame([(str(i), Vectors.dense(x)) for i, x in enumerate(background)], ["row_id", "features"])).agg(F.avg("y").alias("b")).first()["b"]
    return _adds_up(values, model, test, F.lit(base))


@query("permutation_importance", _MATTERS_SQL)
def permutation_importance(spark, sf):
    model, test = _forest(spark, sf)
    return ex.permutation_importance(test, model.transform, "classification", ORDER_FEATURES).select("feature", (F.col("importance") > 0.05).alias("matters"))


@query("native_importance", _MATTERS_SQL)
def native_importance(spark, sf):
    model, _ = _forest(spark, sf)
    return ex.native_importance(model, ORDER_FEATURES, spark).select("feature", (F.col("importance") > 0.05).alias("matters"))


# ---------------------------------------------------------------- leaderboard, artifacts, scoring

QUICK = ["logistic_regression", "gaussian_nb", "decision_tree"]


@query("leaderboard", "SELECT unnest([" + ", ".join(f"'{c.name}'" for c in CLASSIFIERS) + "]) AS model, 'ok' AS status, true AS found_rule")
def leaderboard(spark, sf):
    """The whole bank with its presets, on held-out rows; ``analyze_leaderboard`` has folds."""
    train, test = train_test_split(_binary(spark, sf), ["row_id"], 42)
    rows, _ = training.evaluate_bank(CLASSIFIERS, train, test, "classification", 2, folds=0)
    return training.leaderboard_frame(spark, rows).select("model", "status", (F.col("test_score") >= FOUND).alias("found_rule"))


def _customers(spark, sf):
    """One row per customer with order facts; target: did the customer place an urgent order?"""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_orderdate").alias("last_order"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    c = table(spark, sf, "customer").select(F.col("c_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment")
    out = c.join(o, "c_custkey", "left").withColumn("last_order", F.date_format("last_order", "yyyy-MM-dd"))
    return out.withColumn("Churn", F.when(F.coalesce("urgent", F.lit(0)) == 1, "Yes").otherwise("No")).withColumnRenamed("c_custkey", "customer_id").drop("urgent")


def _analysis(spark, sf, folder=None):
    return run_analysis(_customers(spark, sf), use_case_id="customer_churn", source="customers", bank=[spec(CLASSIFIERS, n) for n in QUICK[:3]],
                        folder=folder)


@query("analyze_leaderboard", "SELECT unnest(['logistic_regression', 'gaussian_nb', 'decision_tree']) AS model, 'ok' AS status, true AS has_probability, true AS in_range")
def analyze_leaderboard(spark, sf):
    score = F.col("test_score")
    return _analysis(spark, sf).leaderboard.select("model", "status", "has_probability", score.between(0, 1).alias("in_range"))


@query("explain_report")
def explain_report(spark, sf):
    return _analysis(spark, sf).explanation


def _staged(spark, sf):
    """A staged artifact trained on the customers without cross-validation."""
    folder = fresh_path(spark, "artifact")
    rows = _customers(spark, sf)
    train = rows.filter(bucket_of(["customer_id"], 5, 42) != 0)
    prep = Preprocessor()
    features = prep.fit_transform(train, "Churn", ["last_order"], ["customer_id"], ["customer_id"])
    label = (F.col("Churn") == "Yes")
    frame = keep(training.assemble(features, prep.feature_columns, label, "customer_id"))
    model = spec(CLASSIFIERS, "logistic_regression").train(frame, context_of(frame, 2))
    meta = {"problem_type": "classification", "classes": ["No", "Yes"], "target": "Churn", "use_case_id": "customer_churn", "best_model": "logistic_regression", "text_columns": []}
    return sinks.save_artifact(spark, f"{folder}/staging", model, prep, meta), folder


@query("sink_model_artifact", """SELECT 'logistic_regression' AS best_model, CAST(9 + count(DISTINCT c_mktsegment) - 1 AS INT) AS n_features, 'No,Yes' AS classes,
  true AS has_probability FROM customer""")
def sink_model_artifact(spark, sf):
    path, _ = _staged(spark, sf)
    model, prep, meta = sinks.load_artifact(spark, path)
    return spark.createDataFrame([(meta["best_model"], len(prep.feature_columns), ",".join(meta["classes"]), model.has_probability)],
                                 "best_model string, n_features int, classes string, has_probability boolean")


@query("promote_model", "SELECT c_custkey AS customer_id, 1::BIGINT AS n_rows, true AS same FROM customer")
def promote_model(spark, sf):
    """The promoted model must score every customer as the staged one does."""
    path, folder = _staged(spark, sf)
    sinks.promote_model(spark, path, f"{folder}/production", True, f"{folder}/versions")
    staged, _ = score_with(spark, path, _customers(spark, sf), ["customer_id"])
    promoted, _ = score_with(spark, f"{folder}/production", _customers(spark, sf), ["customer_id"])
    return _same_scores(staged, promoted)


def _same_scores(one, other):
    """Per customer: rows in ``other``, and whether all of them agree with ``one``."""
    told = one.select("customer_id", F.struct("prediction", F.round("score", 9).alias("score"), "risk_tier", "recommended_action").alias("a"))
    again = other.select("customer_id", F.struct("prediction", F.round("score", 9).alias("score"), "risk_tier", "recommended_action").alias("b"))
    both = told.join(again, "customer_id", "full")
    return both.groupBy("customer_id").agg(F.count("b").alias("n_rows"), F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


@query("score_batch", "SELECT c_custkey AS customer_id, true AS prediction_fits, true AS tier_fits, true AS has_action FROM customer")
def score_batch(spark, sf):
    """Each row's prediction, tier and action must follow from its score; the batch is logged with its input means."""
    path, folder = _staged(spark, sf)
    scored, _ = score_with(spark, path, _customers(spark, sf), ["customer_id"], log=f"{folder}/log", batch="customers")
    template = get_use_case("customer_churn")
    tier = F.when(F.col("score") >= template["high"], "high").when(F.col("score") >= template["medium"], "medium").otherwise("low")
    return scored.select("customer_id", ((F.col("prediction") == "Yes") == (F.col("score") > 0.5)).alias("prediction_fits"),
                         (F.col("risk_tier") == tier).alias("tier_fits"), (F.length("recommended_action") > 0).alias("has_action"))


@query("stream_score", "SELECT c_custkey AS customer_id, 1::BIGINT AS n_rows, true AS same FROM customer")
def stream_score(spark, sf):
    """The batch's records as arriving files: each must be scored once, as ``score_batch`` does."""
    path, folder = _staged(spark, sf)
    _customers(spark, sf).write.parquet(f"{folder}/incoming")
    model, prep, meta = sinks.load_artifact(spark, path)
    incoming = spark.read.parquet(f"{folder}/incoming")
    stream = jobs.read_stream(spark, f"{folder}/incoming", incoming.schema, max_files=4)
    jobs.stream_score(stream, model, prep, meta, f"{folder}/scored", f"{folder}/state", ["customer_id"], log=f"{folder}/log").awaitTermination()
    batch, _ = score_with(spark, path, incoming, ["customer_id"])
    return _same_scores(batch, spark.read.parquet(f"{folder}/scored"))


@query("analyze_clusters")
def analyze_clusters(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    return run_analysis(parts, source="parts", id_columns=["p_partkey"]).leaderboard


@query("analyze_series", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL),
  n AS (SELECT y, row_number() OVER (ORDER BY day) AS i, floor(0.8 * count(*) OVER ()) AS k FROM d), p AS (SELECT avg(y) FILTER (i <= k) AS m FROM n),
  e AS (SELECT CAST(round(avg(abs(y - m))) AS BIGINT) AS mean_mae FROM n, p WHERE i > k)
  SELECT 'all' AS series, model, 'statistical' AS family, mean_mae, true AS ranked, true AS sound
  FROM e CROSS JOIN (VALUES ('ARIMA(1,1,1)'), ('ARIMA(2,1,1)'), ('ARIMA(1,1,2)')) m(model)""")
def analyze_series(spark, sf):
    """The board of the daily revenue, which has no trend: the error of no order may exceed that of the mean of the past by a twentieth."""
    orders = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"))
    board = run_analysis(orders, "revenue", source="daily revenue", allow_continuous=True).leaderboard
    placed = cut(ts.prepare(orders, "day", "revenue"))
    mean = placed.filter("is_train").agg(F.avg("y")).first()[0]
    error = F.lit(placed.filter("not is_train").agg(F.avg(F.abs(F.col("y") - F.lit(mean)))).first()[0])
    by = Window.partitionBy("series").orderBy("test_mae", "model")
    return board.select("series", "model", "family", F.round(error).cast("long").alias("mean_mae"),
                        (F.row_number().over(by) == F.col("rank")).alias("ranked"), (F.col("test_mae") < 1.05 * error).alias("sound"))
