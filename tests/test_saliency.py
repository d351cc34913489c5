"""Token saliency reads the texts once for the vocabulary and once for the weights."""

from conftest import SF

from gleanery import catalog
from gleanery.operators import text as tx


def test_weights_are_made_once(spark):
    out = catalog.queries()["token_saliency"](spark, SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert len(out.collect()) == 10


def test_every_kept_term_has_weights(spark):
    rows = spark.createDataFrame([(1, "red red fox"), (2, "red fox runs"), (3, None), (4, "once")], "id int, text string")
    terms = tx.kept_terms(rows, "text")
    got = {(r["doc"], r["gram"], r["tf"], round(r["weight"], 9)) for r in tx.ngram_tfidf(rows, "id", "text", terms=terms).collect()}
    assert {r["gram"] for r in terms.collect()} == {g for _, g, _, _ in got} == {"red", "fox", "red fox"}
    assert got == {(r["doc"], r["gram"], r["tf"], round(r["weight"], 9)) for r in tx.ngram_tfidf(rows, "id", "text").collect()}


def test_grams_are_counted_in_their_row(spark):
    texts = ["b a b a b", "", "one", None, "xx yy xx yy", "café ünï café"]
    from gleanery.functions.text import counted, unigrams_and_bigrams, words
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: None if r["c"] is None else {g["gram"]: g["n"] for g in r["c"]} for r in rows.select("i", counted(words("t")).alias("c")).collect()}
    assert got == {0: {"a": 2, "b": 3}, 1: {}, 2: {"one": 1}, 3: {}, 4: {"xx": 2, "yy": 2}, 5: {"café": 2, "ünï": 1}}
    grams = {r["i"]: r["g"] for r in rows.select("i", unigrams_and_bigrams(rows["t"]).alias("g")).collect()}
    assert grams == {0: [], 1: [], 2: ["one"], 3: None, 4: ["xx", "yy", "xx", "yy", "xx yy", "yy xx", "xx yy"], 5: ["café", "ünï", "café", "café ünï", "ünï café"]}
    assert rows.select(unigrams_and_bigrams(rows["t"]).alias("g"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
