"""Evaluation, explanation, business output and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.bank import FAMILIES, family_column
from ..models.series import rank_models
from ..operators import evaluate as ev
from ..operators import explain as ex
from ..operators import monitor as mo
from ..operators import scoring as sc
from ..operators import usecases as uc
from ..plans.training import leaderboard_proba_only as proba_only
from ..plans.training import leaderboard_union as union_boards
from .registry import query, table

# ---------------------------------------------------------------- evaluation of planted predictions

_PREDICTED = "(SELECT o_orderpriority AS actual, CASE WHEN o_custkey % 4 = 0 THEN '1-URGENT' WHEN o_custkey % 7 = 0 THEN '6-UNSEEN' ELSE o_orderpriority END AS predicted FROM orders)"


def _predicted(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("actual"), F.when(k % 4 == 0, "1-URGENT").when(k % 7 == 0, "6-UNSEEN").otherwise(F.col("o_orderpriority")).alias("predicted"))


@query("eval_accuracy", f"SELECT round(avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy, count(*) AS n FROM {_PREDICTED}")
def eval_accuracy(spark, sf):
    return ev.accuracy(_predicted(spark, sf), "actual", "predicted")


_LABELS = f"(SELECT actual AS label FROM {_PREDICTED} UNION SELECT predicted FROM {_PREDICTED})"
_SCORES = f"""(SELECT label, support, CASE WHEN said > 0 THEN hit / said::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall,
  CASE WHEN said + support > 0 THEN 2.0::DOUBLE * hit / (said + support) ELSE 0 END AS f1 FROM (SELECT label, (SELECT count(*) FROM {_PREDICTED} p WHERE p.actual = l.label) AS support,
  (SELECT count(*) FROM {_PREDICTED} p WHERE p.predicted = l.label) AS said, (SELECT count(*) FROM {_PREDICTED} p WHERE p.actual = l.label AND p.predicted = l.label) AS hit FROM {_LABELS} l))"""


@query("eval_f1_weighted", f"SELECT round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM {_SCORES}")
def eval_f1_weighted(spark, sf):
    return ev.f1_weighted(_predicted(spark, sf), "actual", "predicted")


@query("eval_class_report", f"""SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM {_SCORES}
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM {_SCORES}
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {_SCORES}""")
def eval_class_report(spark, sf):
    return ev.class_report(_predicted(spark, sf), "actual", "predicted")


@query("eval_confusion", f"SELECT a.label AS actual, p.label AS predicted, (SELECT count(*) FROM {_PREDICTED} x WHERE x.actual = a.label AND x.predicted = p.label) AS n FROM {_LABELS} a CROSS JOIN {_LABELS} p")
def eval_confusion(spark, sf):
    return ev.confusion(_predicted(spark, sf), "actual", "predicted")


@query("eval_regression", """SELECT round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 4) AS r2, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse
  FROM (SELECT l_extendedprice AS a, l_quantity * 1000.0::DOUBLE + l_discount AS p FROM lineitem)""")
def eval_regression(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000.0 + F.col("l_discount")).alias("p"))
    return ev.regression_scores(rows, "a", "p")


_DAILY = "(SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY ALL)"


@query("eval_forecast", f"""SELECT event_type, max(train_size) AS train_size, count(*) AS test_size, round(avg(abs(y - f)), 4) AS test_mae, round(sqrt(avg((y - f) * (y - f))), 4) AS test_rmse FROM (
  SELECT event_type, y, CAST(floor(0.8 * n) AS BIGINT) AS train_size, pos, avg(CASE WHEN pos <= floor(0.8 * n) THEN y END) OVER (PARTITION BY event_type) AS f, n FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM {_DAILY})) WHERE pos > floor(0.8 * n) GROUP BY event_type""")
def eval_forecast(spark, sf):
    from ..operators.split import ordered_split

    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("y")).withColumn("t", F.unix_date("day"))
    placed = ordered_split(daily, "t", ["event_type"])
    level = placed.filter("is_train").groupBy("event_type").agg(F.avg("y").alias("forecast"))
    return ev.forecast_scores(placed.filter("not is_train").join(level, "event_type"), ["event_type"], "y")


@query("eval_silhouette", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT label, count(*) AS n FROM e GROUP BY label),
  d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS total FROM e a CROSS JOIN e b GROUP BY ALL),
  m AS (SELECT vec_id, own, max(CASE WHEN other = own THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> own THEN total / n END) AS b FROM d JOIN s ON s.label = d.other GROUP BY vec_id, own)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette, 'euclidean' AS metric FROM m""")
def eval_silhouette(spark, sf):
    return ev.silhouette(table(spark, sf, "embeddings"), "embedding", "label", metric="euclidean")


# ---------------------------------------------------------------- leaderboards over runs derived from orders

_NAMES = [*FAMILIES, "unheard_of"]
_RUNS = f"""(SELECT o_orderpriority AS dataset, list_extract([{', '.join(repr(n) for n in _NAMES)}], CAST(o_orderkey % {len(_NAMES)} + 1 AS INT)) AS model,
  round(avg(CAST(o_custkey % 97 AS DOUBLE)) / 97, 4) AS test_score FROM orders GROUP BY ALL)"""


def _runs(spark, sf):
    """Average score per (dataset, model), one row each."""
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("o_orderkey") % len(_NAMES)).cast("int"))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), name.alias("model")).agg(
        F.round(F.avg((F.col("o_custkey") % 97).cast("double")) / 97, 4).alias("test_score"))


@query("model_family", f"SELECT dataset, model, CASE model {' '.join(f'WHEN {n!r} THEN {f!r}' for n, f in FAMILIES.items())} ELSE 'other' END AS family FROM {_RUNS}")
def model_family(spark, sf):
    return _runs(spark, sf).select("dataset", "model", family_column(F.col("model")).alias("family"))


@query("leaderboard_proba_only", f"""WITH r AS (SELECT *, model NOT IN ('linear_svc', 'svm_rbf', 'tfidf_linear_svc') AS has_probability FROM {_RUNS})
  SELECT dataset, model, test_score FROM r WHERE has_probability OR NOT (SELECT bool_or(has_probability) FROM r)""")
def leaderboard_proba_only(spark, sf):
    board = _runs(spark, sf).withColumn("has_probability", ~F.col("model").isin("linear_svc", "svm_rbf", "tfidf_linear_svc"))
    return proba_only(board).select("dataset", "model", "test_score")


@query("leaderboard_union", f"SELECT dataset, model, test_score, CAST(row_number() OVER (PARTITION BY dataset ORDER BY test_score DESC, model) AS INT) AS rank FROM {_RUNS}")
def leaderboard_union(spark, sf):
    runs = _runs(spark, sf)
    sequence = F.col("model").isin("embed_windows", "embed_sequence")
    both = union_boards(runs.filter(~sequence), runs.filter(sequence))
    return rank_models(both, ["dataset"], "test_score", False).select("dataset", "model", "test_score", "rank")


@query("ts_rank", f"SELECT dataset, model, 1 - test_score AS test_mae, CAST(row_number() OVER (PARTITION BY dataset ORDER BY 1 - test_score, model) AS INT) AS rank FROM {_RUNS}".replace("1 - test_score", "round(1 - test_score, 4)"))
def ts_rank(spark, sf):
    board = _runs(spark, sf).select("dataset", "model", F.round(1 - F.col("test_score"), 4).alias("test_mae"))
    return rank_models(board, ["dataset"], "test_mae", True)


@query("clu_select", f"""SELECT dataset, model, silhouette_score, CAST(row_number() OVER (PARTITION BY dataset ORDER BY silhouette_score DESC, model) AS INT) AS rank FROM (
  SELECT dataset, model, test_score AS silhouette_score, model LIKE '%t%' AS from_bank, length(model) % 5 AS n_labels, test_score AS noise_share FROM {_RUNS})
  WHERE n_labels >= 2 AND NOT (from_bank AND noise_share > 0.5)""")
def clu_select(spark, sf):
    from ..models.cluster import select_clusterings

    board = _runs(spark, sf).select("dataset", F.concat_ws("/", "dataset", "model").alias("model"), F.lit("clustering").alias("family"), F.col("test_score").alias("silhouette_score"),
                                    F.col("model").contains("t").alias("from_bank"), (F.length("model") % 5).alias("n_labels"), F.col("test_score").alias("noise_share"))
    chosen = select_clusterings(board).select(F.split_part("model", F.lit("/"), F.lit(1)).alias("dataset"), F.split_part("model", F.lit("/"), F.lit(2)).alias("model"), "silhouette_score")
    return rank_models(chosen, ["dataset"], "silhouette_score", False)


# ---------------------------------------------------------------- explanation

_COEFS = {"l_quantity": 2.5, "l_extendedprice": -0.001, "l_discount": 40.0, "l_tax": 7.0}


@query("shap_linear", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs(v)), 6) AS importance FROM (SELECT {k}::DOUBLE * ({c} - avg({c}) OVER ()) AS v FROM lineitem)" for c, k in _COEFS.items()))
def shap_linear(spark, sf):
    values = ex.shap_linear(table(spark, sf, "lineitem").select(*_COEFS), _COEFS)
    return ex.shap_importance(values, list(_COEFS)).withColumn("importance", F.round("importance", 6))


@query("shap_aggregate", """SELECT feature, round(avg(v), 10) AS importance FROM (SELECT r, feature, avg(abs(v)) AS v FROM (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS r, unnest(['quantity', 'discount', 'tax', 'quantity', 'discount', 'tax']) AS feature,
    unnest([l_quantity - 25, l_discount, -l_tax, 2 * l_quantity - 50, -l_discount * 3, l_tax * 2]) AS v FROM lineitem) GROUP BY r, feature) GROUP BY feature""")
def shap_aggregate(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    row = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long"))
    cell = lambda c, f, v: F.struct(F.lit(c).alias("class"), F.lit(f).alias("feature"), v.alias("value"))
    cells = F.array(cell(0, "quantity", q - 25), cell(0, "discount", d), cell(0, "tax", -t), cell(1, "quantity", 2 * q - 50), cell(1, "discount", -d * 3), cell(1, "tax", t * 2))
    values = table(spark, sf, "lineitem").select(row.alias("row"), F.inline(cells))
    return ex.shap_aggregate(values).withColumn("importance", F.round("importance", 10))


_VECTOR = "(SELECT label, unnest(embedding) AS v, 'e' || (unnest(range(1, 65)) - 1) AS feature FROM embeddings)"
_MEANS = f"(SELECT label AS cluster, feature, count(*) AS size, round(avg(CAST(v AS DOUBLE)), 4) AS mean_value FROM {_VECTOR} GROUP BY ALL)"
_EXACT_MEANS = _MEANS.replace("round(avg(CAST(v AS DOUBLE)), 4)", "avg(CAST(v AS DOUBLE))")


def _spread_embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]), [f"e{i}" for i in range(64)]


@query("cluster_profiles", f"""SELECT cluster, size, feature, mean_value, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(mean_value) DESC, feature) AS INT) AS rank FROM {_MEANS}
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(mean_value) DESC, feature) <= 10""")
def cluster_profiles(spark, sf):
    df, names = _spread_embeddings(spark, sf)
    return ex.cluster_profiles(df, "label", names)


@query("cluster_importance", f"SELECT feature, round(var_samp(mean_value), 8) AS importance FROM {_EXACT_MEANS} GROUP BY feature ORDER BY var_samp(mean_value) DESC, feature LIMIT 10")
def cluster_importance(spark, sf):
    df, names = _spread_embeddings(spark, sf)
    return ex.cluster_importance(df, "label", names).withColumn("importance", F.round("importance", 8))


@query("cluster_metrics", "SELECT count(DISTINCT label) AS n_clusters, count(*) AS total_points FROM embeddings")
def cluster_metrics(spark, sf):
    return ex.cluster_metrics(table(spark, sf, "embeddings"), "label")


# ---------------------------------------------------------------- scores, tiers, actions

_IDS = ["customer_churn", "lead_scoring", "fraud_detection", "loan_default"]
_CASE = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_IDS)) + " WHEN 4 THEN 'not_a_template' END"
_SCORED = f"(SELECT c_custkey, c_mktsegment, {_CASE} AS use_case_id, CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_custkey % 101 AS DOUBLE) / 100 END AS p FROM customer)"


def _scored(spark, sf):
    k = F.col("c_custkey")
    which = F.lit(None).cast("string")
    for i, u in enumerate([*_IDS, "not_a_template"]):
        which = F.when(k % 6 == i, u).otherwise(which)
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", which.alias("use_case_id"), F.when(k % 23 != 0, (k % 101).cast("double") / 100).alias("p"))


_TEMPLATES = "(VALUES " + ", ".join(
    f"('{u['id']}', '{u['name']}', {u['high']}::DOUBLE, {u['medium']}::DOUBLE, '{u['probability_label']}', '{u['high_risk_label']}', '{u['target_col']}', '{u['positive_class']}')" for u in uc.USE_CASES) + ") t(id, name, high, medium, label, risk_label, target, positive)"
_ACTIONS = "(VALUES " + ", ".join(f"('{u['id']}', '{t}', '{a}')" for u in uc.USE_CASES for t, a in u["actions"].items()) + ") a(id, tier, action)"
_TIERED = f"""(SELECT s.*, CASE WHEN p IS NULL THEN 'unknown' WHEN p >= coalesce(high, 0.65::DOUBLE) THEN 'high' WHEN p >= coalesce(medium, 0.35::DOUBLE) THEN 'medium' ELSE 'low' END AS risk_tier
  FROM {_SCORED} s LEFT JOIN {_TEMPLATES} ON t.id = s.use_case_id)"""
_ACTED = f"""(SELECT s.*, CASE WHEN risk_tier = 'unknown' THEN 'Review prediction manually.' WHEN use_case_id IS NULL OR use_case_id NOT IN ({', '.join(repr(u) for u in _IDS)})
  THEN 'Review prediction with domain expert.' ELSE coalesce(a.action, 'No action defined.') END AS recommended_action FROM {_TIERED} s LEFT JOIN {_ACTIONS} ON a.id = s.use_case_id AND a.tier = s.risk_tier)"""


@query("use_case_catalog", f"SELECT s.c_custkey, s.use_case_id, t.name, t.target AS target_col, t.positive AS positive_class, t.high, t.medium FROM {_SCORED} s LEFT JOIN {_TEMPLATES} ON t.id = s.use_case_id")
def use_case_catalog(spark, sf):
    catalog = uc.use_case_catalog(spark).select("use_case_id", "name", "target_col", "positive_class", "high", "medium")
    return _scored(spark, sf).select("c_custkey", "use_case_id").join(F.broadcast(catalog), "use_case_id", "left")


@query("risk_tier", f"SELECT c_custkey, p, risk_tier FROM {_TIERED}")
def risk_tier(spark, sf):
    return uc.risk_tier(_scored(spark, sf), "p").select("c_custkey", "p", "risk_tier")


@query("recommended_action", f"SELECT c_custkey, risk_tier, recommended_action FROM {_ACTED}")
def recommended_action(spark, sf):
    return uc.recommended_action(uc.risk_tier(_scored(spark, sf), "p")).select("c_custkey", "risk_tier", "recommended_action")


@query("positive_class_index", f"""SELECT c_custkey, CASE WHEN t.id IS NULL THEN -1 WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS class_index
  FROM {_SCORED} s LEFT JOIN {_TEMPLATES} ON t.id = s.use_case_id""")
def positive_class_index(spark, sf):
    k = F.col("c_custkey")
    classes = F.when(k % 3 == 0, F.array(F.lit("No"), F.lit("Yes"))).when(k % 3 == 1, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("only")))
    catalog = uc.use_case_catalog(spark).select("use_case_id", "positive_class")
    joined = _scored(spark, sf).join(F.broadcast(catalog), "use_case_id", "left")
    index = sc.positive_index_column(classes, F.col("use_case_id"), F.col("positive_class"))
    return joined.select("c_custkey", F.coalesce(index, F.lit(-1)).alias("class_index"))


@query("score_probability", """SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 101 AS DOUBLE) / 100 WHEN c_custkey % 3 = 1 THEN greatest(CAST(c_custkey % 101 AS DOUBLE) / 100, 1 - CAST(c_custkey % 101 AS DOUBLE) / 100)
  WHEN c_custkey % 2 = 0 THEN 1 / (1 + exp(-c_acctbal / 1000)) END, 6) AS score FROM customer""")
def score_probability(spark, sf):
    k = F.col("c_custkey")
    p = (k % 101).cast("double") / 100
    probability = F.when(k % 3 != 2, F.array(1 - p, p))
    margin = F.when((k % 3 == 2) & (k % 2 == 0), F.col("c_acctbal") / 1000)
    index = F.when(k % 3 == 0, 1)
    return table(spark, sf, "customer").select("c_custkey", F.round(sc.score_probability(probability, margin, index), 6).alias("score"))


@query("business_output", f"""SELECT a.c_custkey, a.risk_tier, a.recommended_action, t.name AS use_case, t.label AS probability_label, t.risk_label AS high_risk_label,
  round(a.p, 4) AS probability_score, CASE WHEN t.id = 'customer_churn' THEN round(a.p, 4) END AS churn_probability FROM {_ACTED} a JOIN {_TEMPLATES} ON t.id = a.use_case_id""")
def business_output(spark, sf):
    out = sc.business_output(_scored(spark, sf), "p")
    return out.select("c_custkey", "risk_tier", "recommended_action", "use_case", "probability_label", "high_risk_label", "probability_score", "churn_probability")


@query("build_report", f"""SELECT c_custkey, c_mktsegment, CASE WHEN p >= 0.5 THEN 'Yes' ELSE 'No' END AS prediction, round(p, 4) AS churn_probability, round(p * 100, 1) AS churn_probability_pct, risk_tier, recommended_action FROM {_ACTED}""")
def build_report(spark, sf):
    rows = uc.recommended_action(uc.risk_tier(_scored(spark, sf), "p")).withColumn("said", F.when(F.col("p") >= 0.5, "Yes").otherwise("No"))
    return sc.build_report(rows, ["c_custkey", "c_mktsegment"], "said", "p", "churn_probability", "risk_tier", "recommended_action")


# ---------------------------------------------------------------- monitoring

_TRAIN = "(SELECT event_id, user_id, value FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 20 DAY)"
_BATCH = "(SELECT event_id, user_id, value + 500 AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY)"
_BASE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std FROM {_TRAIN}" for c in ("event_id", "user_id", "value"))


def _drifted(spark, sf):
    e = table(spark, sf, "events")
    # Two moments come back and return as literals, so the range filters reach the scan.
    span = e.agg(F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last")).first()
    day = F.expr("INTERVAL 1 DAY")
    moment = lambda text: F.lit(text).cast("timestamp_ntz")
    train = e.filter(F.col("ts") < moment(span["first"]) + day * 20).select("event_id", "user_id", "value")
    batch = e.filter(F.col("ts") >= moment(span["last"]) - day * 10).select("event_id", "user_id", (F.col("value") + 500).alias("value"))
    return train, batch


@query("save_baseline", f"SELECT \"column\", round(mean, 4) AS mean, round(std, 4) AS std FROM ({_BASE}) WHERE std > 0")
def save_baseline(spark, sf):
    from ..session import fresh_path
    from ..sources.sinks import load_baseline
    from ..sources.sinks import save_baseline as store

    path = fresh_path(spark, "baseline")
    train, _ = _drifted(spark, sf)
    store(mo.training_baseline(train.withColumn("flat", F.lit(1))), path, "m1")
    return load_baseline(spark, path, "m1").select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("batch_means", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS batch_mean FROM {_BATCH}" for c in ("event_id", "user_id", "value")))
def batch_means(spark, sf):
    return mo.batch_means(_drifted(spark, sf)[1]).withColumn("batch_mean", F.round("batch_mean", 4))


_MEANS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) AS batch_mean FROM {_BATCH}" for c in ("event_id", "user_id", "value"))


@query("check_drift", f"""SELECT m."column", round(m.batch_mean, 4) AS batch_mean, round(b.mean, 4) AS mean, round(abs(m.batch_mean - b.mean) / b.std, 4) AS z,
  format('{{}}: incoming mean {{:.3f}} deviates {{:.1f}}σ from training ({{:.3f}})', m."column", m.batch_mean, abs(m.batch_mean - b.mean) / b.std, b.mean) AS warning
  FROM ({_MEANS_SQL}) m JOIN ({_BASE}) b ON b."column" = m."column" WHERE b.std > 0 AND abs(m.batch_mean - b.mean) / b.std > 3""")
def check_drift(spark, sf):
    train, batch = _drifted(spark, sf)
    out = mo.check_drift(batch, mo.training_baseline(train))
    return out.select("column", F.round("batch_mean", 4).alias("batch_mean"), F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"), "warning")
