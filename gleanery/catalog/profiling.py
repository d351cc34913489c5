"""Profiles and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisor, infer, profile as p
from ..operators.infer import IMAGE_SUFFIX
from ..functions.types import select_categorical, select_numeric
from ..plans.training import task_column
from .registry import GAPS_SQL, events_with_gaps, query, table

EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
        f"round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS unique_count, "
        f"count(*) AS n_rows FROM {source}" for c, t in columns.items())


@query("scan_parquet", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer")
def scan_parquet_query(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@query("profile_shape", f"SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM {GAPS_SQL}")
def profile_shape(spark, sf):
    return p.profile_shape(events_with_gaps(spark, sf))


@query("profile_columns", _profile_sql(GAPS_SQL, EVENT_TYPES))
def profile_columns(spark, sf):
    return p.profile_columns(events_with_gaps(spark, sf))


def _numeric_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {source}" for c in columns)


@query("profile_numeric", _numeric_sql(
    "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_quantity > 25 AS bulky FROM lineitem)",
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "CAST(bulky AS INT)"]).replace("'CAST(bulky AS INT)'", "'bulky'"))
def profile_numeric(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", (F.col("l_quantity") > 25).alias("bulky"))
    return p.profile_numeric(lines).select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


_TOPS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", value, n AS count, CAST(row_number() OVER (ORDER BY n DESC, value) AS INT) AS rank FROM "
    f"(SELECT {c} AS value, count(*) AS n FROM part GROUP BY {c})" for c in ("p_name", "p_brand", "p_type"))


@query("profile_top_values", f"SELECT * FROM ({_TOPS}) WHERE rank <= 5")
def profile_top_values(spark, sf):
    return p.top_values(table(spark, sf, "part"))


@query("profile_summary", f"""SELECT count(*) FILTER (missing_count > 0) AS columns_with_missing,
  count(*) FILTER (unique_count > 50) AS high_cardinality_columns FROM ({_profile_sql(GAPS_SQL, EVENT_TYPES)})""")
def profile_summary(spark, sf):
    return p.profile_summary(p.profile_columns(events_with_gaps(spark, sf)))


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("flag_id_columns", f"""SELECT "column", lower("column") IN ('id', 'uuid', 'index', 'key') OR lower("column") LIKE '%id'
  OR (unique_count = n_rows AND unique_count > 20) AS is_id FROM ({_profile_sql('orders', ORDER_TYPES)})""")
def flag_id_columns(spark, sf):
    return p.flag_id_columns(p.profile_columns(table(spark, sf, "orders")))


# ---------------------------------------------------------------- inference

def _dated_orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
                    F.date_format("o_orderdate", "yyyy").alias("year_text"), "o_orderpriority", F.col("o_custkey").cast("string").alias("cust_text"))


_DATED = """(SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day_text, strftime(o_orderdate, '%Y') AS year_text,
  o_orderpriority, CAST(o_custkey AS VARCHAR) AS cust_text FROM orders)"""
_PARSED = """CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(v AS DATE)
  WHEN regexp_matches(v, '^\\d{4}$') AND v <> '0000' THEN make_date(CAST(v AS INT), 1, 1) END"""


@query("detect_datetime", f"""SELECT "column", n_values, n_parsed, CAST(coalesce(min_year, 0) AS INT) AS min_year, CAST(coalesce(max_year, 0) AS INT) AS max_year,
  coalesce(n_values > 0 AND n_parsed >= 0.8 * n_values AND min_year >= 1900 AND max_year <= 2100, false) AS is_datetime FROM (
  SELECT "column", count(v) AS n_values, count(d) AS n_parsed, min(year(d)) AS min_year, max(year(d)) AS max_year FROM (
    SELECT "column", v, {_PARSED} AS d FROM (UNPIVOT {_DATED} ON o_orderstatus, day_text, year_text, o_orderpriority, cust_text
      INTO NAME "column" VALUE v)) GROUP BY 1)""")
def detect_datetime(spark, sf):
    return infer.detect_datetime(_dated_orders(spark, sf)).fillna(0, ["min_year", "max_year"])


def _text_sql(source: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(v) AS n_values, avg(length(v)) AS avg_len, avg(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END) AS avg_words, "
        f"count(DISTINCT v) AS n_unique FROM (SELECT v, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS t FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {source}))"
        for c in columns)
    return f"""SELECT "column", n_values, round(avg_len, 4) AS avg_len, round(avg_words, 4) AS avg_words, n_unique,
      avg_len > 35 OR (avg_len > 12 AND n_unique / n_values > 0.3) OR (avg_len > 8 AND n_unique > 10) OR (avg_words >= 3 AND avg_len > 15) AS is_text
      FROM ({parts})"""


@query("detect_text", _text_sql("documents", ["doc_id", "text", "source", "n_chars"]))
def detect_text(spark, sf):
    out = infer.detect_text(table(spark, sf, "documents"), target="lang")
    return out.withColumn("avg_len", F.round("avg_len", 4)).withColumn("avg_words", F.round("avg_words", 4))


def _image_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("/img/"), F.col("page_id").cast("string"), F.lit(".PNG")).alias("picture"))


_IMAGES = "(SELECT page_id, url, '/img/' || page_id || '.PNG' AS picture FROM pages)"


@query("detect_image", f"""SELECT "column", n_values, n_image, n_values > 0 AND n_image >= 0.6 * n_values AS is_image FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS " + '"column"' + f", count(v) AS n_values, count(*) FILTER (regexp_matches(v, '{IMAGE_SUFFIX}')) AS n_image FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {_IMAGES})"
    for c in ('page_id', 'url', 'picture'))})""")
def detect_image(spark, sf):
    return infer.detect_image(_image_pages(spark, sf))


@query("detect_modality", f"""WITH text AS ({_text_sql('documents', ['doc_id', 'text', 'source', 'n_chars'])}),
  flags AS (SELECT true AS has_tabular, (SELECT bool_or(is_text) FROM text) AS has_text, false AS has_image)
  SELECT CASE WHEN has_text AND has_tabular THEN 'multimodal' WHEN has_text THEN 'text' ELSE 'tabular' END AS primary_modality,
    CASE WHEN has_text THEN 'tabular,text' ELSE 'tabular' END AS modalities, has_text AS is_multimodal, has_tabular, has_text, has_image FROM flags""")
def detect_modality(spark, sf):
    return infer.detect_modality(table(spark, sf, "documents"), target="lang")


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER_COLUMNS = list(ORDER_TYPES)


def _stats_sql(source: str, columns: list[str], numeric: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(DISTINCT {c}) AS n_unique, "
        f"{f'bool_and({c} = round({c}))' if c in numeric else 'false'} AS whole, {str(c in numeric).lower()} AS is_num FROM {source}" for c in columns)


_ORDER_STATS = _stats_sql("orders", _ORDER_COLUMNS, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("validate_target", f"""SELECT "column", n_values, n_unique, status, status = 'ok' AND n_unique / n_values > 0.5 AND n_unique > 50 AS many_values_warning FROM (
  SELECT *, CASE WHEN n_values < 10 THEN 'too_few_rows' WHEN n_unique <= 1 THEN 'single_value'
    WHEN n_unique = n_values AND n_unique > 20 THEN 'unique_identifier'
    WHEN (replace(lower("column"), ' ', '_') IN ('id', 'uuid', 'index', 'key', 'customer_id', 'lead_id', 'parentid') OR lower("column") LIKE '%id') AND n_unique / n_values > 0.85 THEN 'looks_like_id'
    WHEN n_unique > 500 AND n_unique / n_values > 0.8 THEN 'too_many_values' ELSE 'ok' END AS status FROM ({_ORDER_STATS}))
  UNION ALL SELECT 'no_such_column', 0, 0, 'missing_column', false""")
def validate_target(spark, sf):
    return infer.validate_target(table(spark, sf, "orders"), [*_ORDER_COLUMNS, "no_such_column"])


def _task_sql(stats: str, has_datetime: bool) -> str:
    return f"""SELECT "column", CASE WHEN {str(has_datetime).lower()} AND is_num THEN 'time_series'
      WHEN is_num AND n_unique <= 20 AND (n_unique / n_values < 0.3 OR n_unique <= 10) AND whole THEN 'classification'
      WHEN is_num THEN 'regression' ELSE 'classification' END AS problem_type FROM ({stats})"""


_LINE_NUMERIC = _LINE_COLUMNS[:8]


@query("detect_problem_type", _task_sql(_stats_sql("lineitem", _LINE_COLUMNS, _LINE_NUMERIC), False))
def detect_problem_type(spark, sf):
    return infer.problem_type_of(infer.target_statistics(table(spark, sf, "lineitem")), False)


@query("class_count", "SELECT count(DISTINCT event_type) AS n_classes FROM " + GAPS_SQL)
def class_count(spark, sf):
    return infer.class_count(events_with_gaps(spark, sf), "event_type")


@query("select_numeric", "SELECT p_partkey, p_size, round(p_retailprice, 4) AS p_retailprice FROM part")
def select_numeric_query(spark, sf):
    return select_numeric(table(spark, sf, "part")).withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("select_categorical", "SELECT p_name, p_brand, p_type, p_size > 25 AS large FROM part")
def select_categorical_query(spark, sf):
    return select_categorical(table(spark, sf, "part").withColumn("large", F.col("p_size") > 25))


# ---------------------------------------------------------------- advice: one descriptor per (table, target)

_DESCRIBED = [("orders", _ORDER_COLUMNS), ("lineitem", _LINE_COLUMNS), ("documents", ["doc_id", "text", "lang", "source", "n_chars"])]


def _descriptors(spark, sf):
    out = None
    for name, columns in _DESCRIBED:
        df = table(spark, sf, name)
        tasks = infer.problem_type_of(infer.target_statistics(df), False)
        text = infer.detect_text(df).agg(F.max(F.struct(F.col("is_text").cast("int").alias("hit"))).getField("hit").alias("any"), F.collect_list(F.when(F.col("is_text"), F.col("column"))).alias("names"))
        shape = df.agg(F.count(F.lit(1)).alias("n_rows"))
        # A target is not an input, so a data set has text when a column other than its target does.
        one = (tasks.join(F.broadcast(text)).join(F.broadcast(shape))
               .withColumn("n_text", F.size(F.filter("names", lambda c: c != F.col("column"))))
               .select(F.concat(F.lit(name + "."), F.col("column")).alias("dataset"), "problem_type", (F.col("n_text") > 0).alias("has_text"),
                       F.lit(False).alias("has_image"), (F.col("n_text") > 0).alias("is_multimodal"), F.col("n_text").cast("long").alias("n_text"), "n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _descriptors_sql() -> str:
    numeric = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": _LINE_NUMERIC, "documents": ["doc_id", "n_chars"]}
    parts = []
    for name, columns in _DESCRIBED:
        # Numbers with a fraction print differently among engines; their length decides nothing here beyond the bound of 8.
        tasks = _task_sql(_stats_sql(name, columns, numeric[name]), False)
        text = _text_sql(name, columns)
        parts.append(f"""SELECT '{name}.' || t."column" AS dataset, t.problem_type, n_text > 0 AS has_text, false AS has_image, n_text > 0 AS is_multimodal, n_text, n_rows
          FROM (SELECT t.*, (SELECT count(*) FROM ({text}) x WHERE x.is_text AND x."column" <> t."column") AS n_text, (SELECT count(*) FROM {name}) AS n_rows FROM ({tasks}) t) t""")
    return " UNION ALL ".join(parts)


def _rules_sql() -> str:
    rows = []
    for i, (g, a, f, _, _, t, pr, _) in enumerate(advisor.RULES):
        rows.append(f"('{g}', {i}, '{a}', '{f}', {str(True if t is None else t).lower()}, {pr})")
    return "(VALUES " + ", ".join(rows) + ") r(rule_group, rule_ord, architecture, family, implemented, priority)"


_ADVICE_SQL = f"""WITH d AS ({_descriptors_sql()}),
  g AS (SELECT dataset, unnest([x for x in [
    CASE WHEN problem_type IN ('classification', 'regression') THEN 'tabular' END, CASE WHEN problem_type = 'clustering' THEN 'clustering' END,
    CASE WHEN problem_type IN ('classification', 'regression') AND has_text THEN 'text' END, CASE WHEN has_image THEN 'image' END,
    CASE WHEN problem_type = 'time_series' THEN 'time_series' END, CASE WHEN is_multimodal THEN 'multimodal' END,
    CASE WHEN problem_type = 'regression' OR has_text THEN 'generative' END] if x IS NOT NULL]) AS rule_group FROM d),
  j AS (SELECT g.dataset, r.* FROM g JOIN {_rules_sql()} ON r.rule_group = g.rule_group),
  u AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY dataset, architecture ORDER BY priority DESC, rule_ord) = 1)
  SELECT dataset, architecture, family, implemented, CAST(priority AS INT) AS priority, CAST(row_number() OVER (PARTITION BY dataset ORDER BY priority DESC, rule_ord) AS INT) AS rank
  FROM u QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY priority DESC, rule_ord) <= 12"""


@query("recommend_architectures", _ADVICE_SQL)
def recommend_architectures(spark, sf):
    return advisor.recommend_architectures(_descriptors(spark, sf)).select("dataset", "architecture", "family", "implemented", "priority", "rank")


@query("recommend_architectures_by_family", f"""SELECT dataset, family, string_agg(architecture, '; ' ORDER BY rank) AS architectures FROM ({_ADVICE_SQL}) GROUP BY dataset, family""")
def recommend_by_family(spark, sf):
    out = advisor.by_family(advisor.recommend_architectures(_descriptors(spark, sf)))
    return out.withColumn("architectures", F.array_join("architectures", "; "))


@query("dispatch_task", f"""SELECT dataset, problem_type, CASE WHEN problem_type IN ('clustering', 'time_series') THEN problem_type
  WHEN problem_type = 'classification' AND n_text > 0 AND n_rows >= 16 THEN 'text' WHEN n_text > 0 AND n_rows >= 30 THEN 'tabular+sequence' ELSE 'tabular' END AS route
  FROM ({_descriptors_sql()})""")
def dispatch_task(spark, sf):
    route = task_column(F.col("problem_type"), F.col("n_text"), F.col("n_rows"), F.lit(0))
    return _descriptors(spark, sf).select("dataset", "problem_type", route.alias("route"))
