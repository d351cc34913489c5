"""Feature encoding, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import split as sp
from .registry import GAPS_SQL, LINE_KEYS, LINES_SQL, events_with_gaps, lines_with_key, query, table, token_sql


def _dates_sql(column: str, name: str) -> str:
    return f"""CAST(year({column}) AS INT) AS {name}_year, CAST(month({column}) AS INT) AS {name}_month, CAST(day({column}) AS INT) AS {name}_day,
      CAST(isodow({column}) - 1 AS INT) AS {name}_dayofweek, CASE WHEN isodow({column}) >= 6 THEN 1 ELSE 0 END AS {name}_is_weekend"""


@query("datetime_features", f"SELECT o_orderkey, {_dates_sql('o_orderdate', 'o_orderdate')}, {_dates_sql('o_orderdate', 'day_text')} FROM orders")
def datetime_features(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"))
    return f.datetime_features(o, ["o_orderdate", "day_text"])


@query("cardinality_split", "SELECT \"column\", n_unique, CASE WHEN n_unique <= 15 THEN 'low' ELSE 'high' END AS cardinality FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM part" for c in ("p_name", "p_brand")) + ")")
def cardinality_split(spark, sf):
    return f.cardinality_split(table(spark, sf, "part"), target="p_type")


@query("one_hot_drop_first", f"""WITH v AS (SELECT DISTINCT event_type AS t FROM {GAPS_SQL} WHERE event_type IS NOT NULL),
  kept AS (SELECT t FROM v QUALIFY row_number() OVER (ORDER BY t) > 1)
  SELECT e.event_id, 'event_type_' || k.t AS dummy, CASE WHEN e.event_type = k.t THEN 1 ELSE 0 END AS value FROM {GAPS_SQL} e CROSS JOIN kept k""")
def one_hot_drop_first(spark, sf):
    out = f.one_hot_drop_first(events_with_gaps(spark, sf).select("event_id", "event_type"), ["event_type"])
    dummies = [c for c in out.columns if c != "event_id"]
    return out.select("event_id", F.inline(F.array(*[F.struct(F.lit(c).alias("dummy"), F.col(f"`{c}`").alias("value")) for c in dummies])))


@query("frequency_encode", "SELECT p_partkey, p_brand, round(b / n, 6) AS p_brand_freq FROM (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand)::DOUBLE AS b, count(*) OVER () AS n FROM part)")
def frequency_encode(spark, sf):
    out = f.frequency_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")
    return out.withColumn("p_brand_freq", F.round("p_brand_freq", 6))


def _enc_sql(n: str, s: str, gn: str, gs: str) -> str:
    """Smoothed mean of a 0/1 outcome from its sums (the sum of squares equals the sum)."""
    mean, overall = f"({s}::DOUBLE / {n})", f"({gs}::DOUBLE / {gn})"
    within, between = f"({mean} - {mean} * {mean})", f"({overall} - {overall} * {overall})"
    weight = f"({between} * {n} / nullif({between} * {n} + {within}, 0))"
    return f"coalesce({weight} * {mean} + (1 - {weight}) * {overall}, {overall})"


@query("target_encode", f"""WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS category, count(*) AS n, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS s FROM lineitem GROUP BY 1),
  g AS (SELECT sum(n) AS gn, sum(s) AS gs FROM c) SELECT category, CAST(n AS BIGINT) AS n, round({_enc_sql('n', 's', 'gn', 'gs')}, 6) AS encoding FROM c, g""")
def target_encode(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_partkey", F.col("l_partkey").cast("string"))
    return f.target_encodings(lines, "l_partkey", "l_linestatus", ["F", "O"]).withColumn("encoding", F.round("encoding", 6))


@query("target_encode_oof", f"""WITH r AS (SELECT *, CAST({token_sql(*LINE_KEYS)} % 5 AS INT) AS fold, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM {LINES_SQL}),
  s AS (SELECT l_partkey, fold, count(*) AS n, sum(y) AS s FROM r GROUP BY ALL), fs AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM s GROUP BY fold),
  g AS (SELECT fold, (SELECT sum(n) FROM fs) - n AS gn, (SELECT sum(s) FROM fs) - s AS gs FROM fs),
  o AS (SELECT l_partkey, s.fold, sum(n) OVER (PARTITION BY l_partkey) - n AS n, sum(s) OVER (PARTITION BY l_partkey) - s AS s, gn, gs FROM s JOIN g ON s.fold = g.fold)
  SELECT {', '.join('r.' + k for k in LINE_KEYS)}, round(CASE WHEN o.n > 0 THEN {_enc_sql('nullif(o.n, 0)', 'o.s', 'gn', 'gs')} ELSE gs::DOUBLE / gn END, 6) AS l_partkey_te
  FROM r JOIN o ON r.l_partkey = o.l_partkey AND r.fold = o.fold""")
def target_encode_oof(spark, sf):
    out = f.target_encode_oof(lines_with_key(spark, sf), "l_partkey", "l_linestatus", ["F", "O"], LINE_KEYS)
    return out.select(*LINE_KEYS, F.round("l_partkey_te", 6).alias("l_partkey_te"))


@query("target_encode_multiclass", " UNION ALL ".join(f"""SELECT p_brand AS category, '{t}' AS class, round({_enc_sql('n', 's', 'gn', 'gs')}, 6) AS encoding FROM
  (SELECT p_brand, count(*) AS n, sum(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS s FROM part GROUP BY 1),
  (SELECT count(*) AS gn, sum(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS gs FROM part)""" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))
def target_encode_multiclass(spark, sf):
    part = table(spark, sf, "part")
    classes = f.class_values(part, "p_type")
    out = f.target_encodings(part, "p_brand", "p_type", classes)
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.round(F.col(f"`encoding_{c}`"), 6).alias("encoding")) for c in classes])
    return out.select("category", F.inline(cells))


@query("standard_scale", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, 0.0::DOUBLE AS flat FROM part")
def standard_scale(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7).alias("flat"))
    out = f.standard_scale(part, exclude=["p_partkey"])
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"), "flat")


@query("label_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders")
def label_encode(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", f.label_encode("o_orderpriority", f.label_classes(o, "o_orderpriority")).alias("label"))


@query("label_decode", "SELECT o_orderkey, o_orderpriority AS decoded FROM orders")
def label_decode(spark, sf):
    o = table(spark, sf, "orders")
    classes = f.label_classes(o, "o_orderpriority")
    coded = o.select("o_orderkey", f.label_encode("o_orderpriority", classes).alias("label"))
    return coded.select("o_orderkey", f.label_decode(F.col("label"), classes).alias("decoded"))


# The whole chain on parts: date text, one-hot, frequency (no target) and scaling.
def _dated_parts(spark, sf):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int"))
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", F.date_format(day, "yyyy-MM-dd").alias("seen"))


_DATED_PARTS = "(SELECT *, DATE '2020-01-01' + CAST(p_partkey % 400 AS INT) AS seen FROM part)"


def _z(expr: str, name: str, over: str = "b") -> str:
    return f"round(({over}.{expr} - s.m_{name}) / CASE WHEN s.s_{name} = 0 THEN 1 ELSE s.s_{name} END, 5) AS {name}"


_CHAIN_COLUMNS = {"p_size": "p_size", "p_retailprice": "p_retailprice", "seen_year": "seen_year", "seen_month": "seen_month", "seen_day": "seen_day",
                  "seen_dayofweek": "seen_dayofweek", "seen_is_weekend": "seen_is_weekend", "p_brand": "p_brand"}


def _chain_sql(rows: str) -> str:
    base = """SELECT p_partkey, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, year(seen)::DOUBLE AS seen_year, month(seen)::DOUBLE AS seen_month,
      day(seen)::DOUBLE AS seen_day, (isodow(seen) - 1)::DOUBLE AS seen_dayofweek, CASE WHEN isodow(seen) >= 6 THEN 1.0::DOUBLE ELSE 0 END AS seen_is_weekend,
      coalesce(q.freq, 0) AS p_brand FROM {src} p LEFT JOIN (SELECT p_brand AS br, count(*)::DOUBLE / (SELECT count(*) FROM part) AS freq FROM part GROUP BY 1) q ON q.br = p.p_brand"""
    fit = base.replace("{src}", _DATED_PARTS)
    now = base.replace("{src}", rows)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _CHAIN_COLUMNS)
    dummies = ", ".join(f"CASE WHEN b.p_type = '{t}' THEN 1.0::DOUBLE ELSE 0 END AS p_type_{t}" for t in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    return f"WITH s AS (SELECT {stats} FROM ({fit})), b AS ({now}) SELECT b.p_partkey, {', '.join(_z(c, c) for c in _CHAIN_COLUMNS)}, {dummies} FROM b, s"


def _rounded(df):
    return df.select("p_partkey", *[F.round(c, 5).alias(c) for c in df.columns if c != "p_partkey"])


@query("preprocess_fit_transform", _chain_sql(_DATED_PARTS))
def preprocess_fit_transform(spark, sf):
    out = f.Preprocessor().fit_transform(_dated_parts(spark, sf), None, ["seen"], ["p_partkey"], ["p_partkey"])
    return _rounded(out)


_NEW_PARTS = """(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'UNSEEN' ELSE p_type END AS p_type,
  p_size + 1 AS p_size, p_retailprice * 2 AS p_retailprice, seen FROM """ + _DATED_PARTS + ")"


@query("preprocess_transform", _chain_sql(_NEW_PARTS))
def preprocess_transform(spark, sf):
    prep = f.Preprocessor().fit(_dated_parts(spark, sf), target=None, datetime_cols=["seen"], exclude=["p_partkey"], keys=["p_partkey"])
    k = F.col("p_partkey")
    new = _dated_parts(spark, sf).select("p_partkey", F.when(k % 5 == 0, "Brand#new").otherwise(F.col("p_brand")).alias("p_brand"),
                                         F.when(k % 3 == 0, "UNSEEN").otherwise(F.col("p_type")).alias("p_type"),
                                         (F.col("p_size") + 1).alias("p_size"), (F.col("p_retailprice") * 2).alias("p_retailprice"), "seen")
    return _rounded(prep.transform(new, ["p_partkey"]))


# ---------------------------------------------------------------- splits and folds

@query("train_test_split", f"SELECT o_orderkey, {token_sql('o_orderkey', seed=42)} % 5 = 0 AS is_test FROM orders")
def train_test_split(spark, sf):
    train, test = sp.train_test_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 42)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("ordered_split", """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position,
  CAST(floor(0.8 * count(*) OVER (PARTITION BY event_type)) AS BIGINT) AS train_size,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= floor(0.8 * count(*) OVER (PARTITION BY event_type)) AS is_train FROM events""")
def ordered_split(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return sp.ordered_split(e, "t", ["event_type"], "event_id").select("event_type", "event_id", "position", "train_size", "is_train")


@query("kfold_assign", f"SELECT o_orderkey, CAST({token_sql('o_orderkey')} % 3 AS INT) AS fold FROM orders")
def kfold_assign(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sp.kfold_assign(["o_orderkey"], sp.fold_count(15)).alias("fold"))


@query("kfold_stratified", f"""SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY {token_sql('o_orderkey')}, CAST(o_orderkey AS VARCHAR)) - 1) % 3 AS INT) AS fold FROM orders""")
def kfold_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sp.stratified_folds(o, "o_orderpriority", ["o_orderkey"], 3)
