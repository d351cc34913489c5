"""Selection and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_filled, joined_text
from ..operators import clean
from ..operators.features import reindex_features
from ..operators.iforest import detect_anomalies as flag_anomalies
from ..operators.knn import impute_knn as knn_fill
from ..operators.split import dropna_subset as complete_rows
from ..sources.readers import select_raw_inputs as raw_inputs
from .registry import GAPS_SQL, events_with_gaps, query, table


@query("drop_id_columns", "SELECT o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders")
def drop_id_columns(spark, sf):
    out = clean.drop_id_columns(table(spark, sf, "orders").drop("o_orderdate"), ["o_orderkey", "o_custkey", "not_there"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("select_raw_inputs", "SELECT p_brand, p_type, p_size FROM part")
def select_raw_inputs(spark, sf):
    part = table(spark, sf, "part").withColumn("is_anomaly", F.lit(0))
    target, ids = "p_retailprice", ["p_partkey", "p_name"]
    return raw_inputs(part, [c for c in part.columns if c not in (target, "is_anomaly", *ids)])


@query("reindex_features", "SELECT CAST(0 AS INT) AS absent, p_size, p_partkey FROM part")
def reindex(spark, sf):
    return reindex_features(table(spark, sf, "part"), ["absent", "p_size", "p_partkey"])


@query("dropna_subset", f"SELECT event_id, event_type, round(value, 4) AS value FROM {GAPS_SQL} WHERE event_type IS NOT NULL AND value IS NOT NULL")
def dropna_subset(spark, sf):
    return complete_rows(events_with_gaps(spark, sf), ["event_type", "value"]).select("event_id", "event_type", F.round("value", 4).alias("value"))


@query("combine_text", f"SELECT event_id, concat_ws(' ', event_type, props) AS text FROM {GAPS_SQL}")
def combine_text(spark, sf):
    return events_with_gaps(spark, sf).select("event_id", joined_text(["event_type", "props"]).alias("text"))


@query("first_image_path", """SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '/img/' || page_id || '.png' WHEN page_id % 3 = 1 THEN '' END, ''),
  CASE WHEN page_id % 2 = 0 THEN url END, '') AS path FROM pages""")
def first_image_path(spark, sf):
    pages = table(spark, sf, "pages")
    k = F.col("page_id")
    marked = pages.select("page_id", F.when(k % 3 == 0, F.concat(F.lit("/img/"), k.cast("string"), F.lit(".png"))).when(k % 3 == 1, "").alias("thumb"),
                          F.when(k % 2 == 0, F.col("url")).alias("photo"))
    return marked.select("page_id", first_filled(["thumb", "photo"]).alias("path"))


_REPEATED = "SELECT ts, user_id, event_type, value, props FROM events UNION ALL SELECT ts, user_id, event_type, value, props FROM events WHERE event_id % 13 = 0"


@query("dedupe_rows", f"SELECT DISTINCT CAST(ts AS VARCHAR) AS ts, user_id, event_type, round(value, 4) AS value, props FROM ({_REPEATED})")
def dedupe_rows(spark, sf):
    e = table(spark, sf, "events").withColumn("copies", F.when(F.col("event_id") % 13 == 0, 2).otherwise(1))
    rows = e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("ts", "user_id", "event_type", "value", "props")
    out = clean.dedupe_rows(rows)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format("ts", "SSSSSS")
    full = F.when(micros == "000000", text).otherwise(F.concat(text, F.lit("."), F.regexp_replace(micros, "0+$", "")))
    return out.select(full.alias("ts"), "user_id", "event_type", F.round("value", 4).alias("value"), "props")


@query("impute_median", f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {GAPS_SQL})), 6) AS value FROM {GAPS_SQL}")
def impute_median(spark, sf):
    out = clean.impute_median(events_with_gaps(spark, sf), ["value"])
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("impute_mode", f"""SELECT event_id, coalesce(event_type, (SELECT event_type FROM {GAPS_SQL} WHERE event_type IS NOT NULL GROUP BY event_type
  ORDER BY count(*) DESC, event_type LIMIT 1), 'Unknown') AS event_type, 'Unknown' AS blank FROM {GAPS_SQL}""")
def impute_mode(spark, sf):
    e = events_with_gaps(spark, sf).withColumn("blank", F.lit(None).cast("string"))
    return clean.impute_mode(e, ["event_type", "blank"]).select("event_id", "event_type", "blank")


_KNN_PARTS = """(SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS a,
  CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice / 100 END AS b, CAST(p_partkey % 17 AS DOUBLE) AS c FROM part)"""


def _knn_fill_sql(column: str) -> str:
    terms = " + ".join(f"coalesce((q.{x} - r.{x}) * (q.{x} - r.{x}), 0)" for x in "abc")
    shared = " + ".join(f"CASE WHEN q.{x} IS NOT NULL AND r.{x} IS NOT NULL THEN 1 ELSE 0 END" for x in "abc")
    return f"""(SELECT k, avg(v) AS v FROM (SELECT q.p_partkey AS k, r.{column} AS v, row_number() OVER (PARTITION BY q.p_partkey ORDER BY
      sqrt(({terms}) * (3.0::DOUBLE / ({shared}))), r.p_partkey) AS n FROM {_KNN_PARTS} q JOIN {_KNN_PARTS} r ON r.{column} IS NOT NULL WHERE q.{column} IS NULL) WHERE n <= 5 GROUP BY k)"""


@query("impute_knn", f"""SELECT p.p_partkey, round(coalesce(p.a, fa.v), 4) AS a, round(coalesce(p.b, fb.v), 4) AS b, p.c FROM {_KNN_PARTS} p
  LEFT JOIN {_knn_fill_sql('a')} fa ON fa.k = p.p_partkey LEFT JOIN {_knn_fill_sql('b')} fb ON fb.k = p.p_partkey""")
def impute_knn(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select("p_partkey", F.when(k % 11 != 0, F.col("p_size").cast("double")).alias("a"),
                                           F.when(k % 13 != 0, F.col("p_retailprice") / 100).alias("b"), (k % 17).cast("double").alias("c"))
    out = knn_fill(part, "p_partkey", ["a", "b", "c"])
    return out.select("p_partkey", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "c")


@query("detect_anomalies", """SELECT count(*) AS n, count(*) FILTER (l_orderkey % 997 = 0) AS n_planted, true AS share_holds, true AS planted_stand_out FROM lineitem""")
def detect_anomalies(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_quantity", F.when(F.col("l_orderkey") % 997 == 0, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity")))
    out = flag_anomalies(lines)
    planted, flagged = F.col("l_orderkey") % 997 == 0, F.col("is_anomaly") == 1
    found = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(planted).alias("n_planted"), F.count_if(flagged).alias("n_flagged"), F.count_if(planted & flagged).alias("both"))
    # A fiftieth of the rows is flagged, and a planted row at least four times as often as any row.
    return found.select("n", "n_planted", (F.abs(F.col("n_flagged") - 0.02 * F.col("n")) <= 1 + 0.002 * F.col("n")).alias("share_holds"),
                        (F.col("both") * F.col("n") >= 4 * F.col("n_flagged") * F.col("n_planted")).alias("planted_stand_out"))


_LEAK_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "leak"]


@query("detect_leakage", "SELECT \"column\", round(abs_corr, 6) AS abs_corr FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", abs(corr(CAST({c} AS DOUBLE), l_extendedprice)) AS abs_corr FROM (SELECT *, l_extendedprice * 2 + 1 AS leak FROM lineitem)" for c in _LEAK_COLUMNS)
    + ") WHERE abs_corr > 0.98")
def detect_leakage(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("leak", F.col("l_extendedprice") * 2 + 1)
    return clean.detect_leakage(lines, "l_extendedprice").select("column", F.round("abs_corr", 6).alias("abs_corr"))
