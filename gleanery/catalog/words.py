"""Text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import text as tx
from ..operators.explain import token_saliency as saliency
from .registry import query, table

_WORDS = "regexp_extract_all(lower(text), '[\\pL\\pN_\\pM]+')"
_VOCAB = f"""(SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INT) AS id, n AS count FROM
  (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word) QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 14998
  UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '<unk>', 1, 0)"""


@query("tokenize_words", f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def tokenize_words(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("build_vocab", f"SELECT word, id, CAST(count AS BIGINT) AS count FROM {_VOCAB}")
def build_vocab(spark, sf):
    return tx.build_vocab(table(spark, sf, "documents"), "text")


_ENCODED = f"""(SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n FROM (
  SELECT d.doc_id, d.pos, coalesce(v.id, 1) AS id FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM
    (SELECT doc_id, list_slice({_WORDS}, 1, 128) AS w FROM documents)) d LEFT JOIN {_VOCAB} v ON v.word = d.word) GROUP BY doc_id)"""


@query("encode_tokens", f"""SELECT d.doc_id, array_to_string(list_concat(coalesce(string_split(e.ids, ','), []::VARCHAR[]), ['0' for x in range((128 - coalesce(e.n, 0))::BIGINT)]), ',') AS ids
  FROM documents d LEFT JOIN {_ENCODED} e ON e.doc_id = d.doc_id""")
def encode_tokens(spark, sf):
    d = table(spark, sf, "documents")
    out = tx.encode_tokens(d, "text", tx.vocab_map(tx.build_vocab(d, "text")))
    return out.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("decode_tokens", f"""SELECT doc_id, string_agg(coalesce(v.word, '<unk>'), ' ' ORDER BY pos) AS tokens FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM
  (SELECT doc_id, list_concat(list_slice({_WORDS}, 1, 128), ['<pad>' for x in range(greatest(0, 128 - len({_WORDS}))::BIGINT)]) AS w FROM documents)) d
  LEFT JOIN {_VOCAB} v ON v.word = d.word GROUP BY doc_id""")
def decode_tokens(spark, sf):
    d = table(spark, sf, "documents")
    vocab = tx.vocab_map(tx.build_vocab(d, "text"))
    out = tx.decode_tokens(tx.encode_tokens(d, "text", vocab), "ids", vocab)
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_GRAMS = f"""(SELECT doc_id AS doc, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS gram FROM
  (SELECT doc_id, [x for x in {_WORDS} if length(x) >= 2] AS w FROM documents)) GROUP BY ALL)"""
_TERMS = f"""(SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM (SELECT gram, sum(tf) AS cf, count(*) AS df FROM {_GRAMS} GROUP BY gram HAVING count(*) >= 2)
  QUALIFY row_number() OVER (ORDER BY cf DESC, gram) <= 8000)"""
_TFIDF = f"""(SELECT doc, gram, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS weight FROM (SELECT c.doc, c.gram, c.tf, c.tf * t.idf AS raw FROM {_GRAMS} c JOIN {_TERMS} t ON t.gram = c.gram))"""


@query("ngram_tfidf", f"SELECT doc, gram, tf, round(weight, 6) AS weight FROM {_TFIDF}")
def ngram_tfidf(spark, sf):
    return tx.ngram_tfidf(table(spark, sf, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("token_saliency", f"""SELECT gram AS token, round(sum(abs(weight * ((length(gram) % 7 - 3) / 10.0::DOUBLE))), 4) AS score FROM {_TFIDF} GROUP BY gram
  HAVING round(sum(abs(weight * ((length(gram) % 7 - 3) / 10.0::DOUBLE))), 4) > 0 ORDER BY score DESC, token LIMIT 10""")
def token_saliency(spark, sf):
    d = table(spark, sf, "documents")
    terms = tx.kept_terms(d, "text")
    weights = tx.ngram_tfidf(d, "doc_id", "text", terms=terms)
    coefficients = terms.select("gram").withColumn("coefficient", (F.length("gram") % 7 - 3) / F.lit(10.0))
    return saliency(weights, coefficients)
