"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from . import alignment, dedup, language, manifest, mixing, overlap, pieces, quality, secrets, tokencount, topk, toxicity, urls
from .common import fold_of, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
         urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def _query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    """A public tokenizer's model; half a megabyte, read by the driver and sent along with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The same for a tokenizer in one JSON file of about a megabyte."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (an + bn - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN root ON doc_id = a
"""


@_query("op1_minhash_near_dedup", _NEAR_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), dedup.MinHash(words=2))


@_query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), model_bytes())


@_query("op3_url_filters")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@_query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(cut(mixing.sized(table(spark, sf_dir, "documents"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op5_exact_top_k", _TOP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(topk.vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of("doc_id", 4) == 2)
    profiles = language.fit_profiles(docs.filter(~F.col("held_out")))
    return language.identify(docs, profiles, keys=("doc_id", "held_out"))


@_query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@_query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("distance")


@_query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), model_bytes())
    return encoded.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "restored")


@_query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of("doc_id", 5)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@_query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_json(), model_bytes())


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_MERKLE_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) & 1 AS low FROM documents),
base AS (SELECT doc_id, source, sha256({_FIELDS}) AS leaf, CASE WHEN low = 1 THEN sha256({_FIELDS.replace("text", "replace(text, chr(10), '')").replace("replace(text, chr(10), '') IS NULL", "text IS NULL")}) END AS changed FROM marked),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM base),
lower_tree AS (
  SELECT 0 AS level, tree, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY level, tree, pos // 3, n),
subroots AS (SELECT tree, h FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY level, pos // 3, n),
low_runs AS (SELECT level, tree, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM lower_tree WHERE n > 1 GROUP BY level, tree, pos // 3),
high_runs AS (SELECT level, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM upper_tree WHERE n > 1 GROUP BY level, pos // 3),
low_steps AS (
  SELECT l.tree, l.pos, r.level, (l.pos // CAST(pow(3, r.level) AS BIGINT)) % 3 AS slot, r.hs
  FROM leaves l JOIN (SELECT DISTINCT tree, level FROM low_runs) d ON d.tree = l.tree
  JOIN low_runs r ON r.tree = l.tree AND r.level = d.level AND r.up = l.pos // CAST(pow(3, d.level + 1) AS BIGINT)),
high_steps AS (
  SELECT s.tree, r.level, (s.tree // CAST(pow(3, r.level) AS BIGINT)) % 3 AS slot, r.hs
  FROM subroots s CROSS JOIN (SELECT DISTINCT level FROM high_runs) d
  JOIN high_runs r ON r.level = d.level AND r.up = s.tree // CAST(pow(3, d.level + 1) AS BIGINT)),
low_ways AS (
  SELECT tree, pos, list({{'l': array_to_string(hs[:slot], ''), 'r': array_to_string(hs[slot + 2:], '')}} ORDER BY level) AS way FROM low_steps GROUP BY tree, pos),
high_ways AS (SELECT tree, list({{'l': array_to_string(hs[:slot], ''), 'r': array_to_string(hs[slot + 2:], '')}} ORDER BY level) AS way FROM high_steps GROUP BY tree),
ways AS (
  SELECT l.doc_id, l.leaf, l.changed, s.h AS subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root,
    list_concat(coalesce(a.way, []), coalesce(b.way, [])) AS way
  FROM leaves l JOIN subroots s ON s.tree = l.tree LEFT JOIN low_ways a ON a.tree = l.tree AND a.pos = l.pos LEFT JOIN high_ways b ON b.tree = l.tree),
folded AS (
  SELECT *, list_reduce(list_prepend({{'l': coalesce(changed, leaf), 'r': ''}}, way), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM folded
"""


@_query("op12_merkle_manifest", _MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


_NGRAM_SQL = _NEAR_SQL.replace("WHEN len(w) = 1 THEN [w[1]]", "WHEN len(w) < 4 THEN [array_to_string(w, ' ')]").replace(
    "range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]", "range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')").replace(
    ">= 80 *", ">= 85 *").replace(", doc_id = component_id AS kept", "")


@_query("op13_ngram_join", _NGRAM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.ngram_components(table(spark, sf_dir, "documents"))
