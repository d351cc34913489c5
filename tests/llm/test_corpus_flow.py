"""URL filters, the mix of sources, and the pipeline."""

import re

import pytest

import corpus_pipeline
from conftest import SF
from gleanery.llm import mixing, urls
from gleanery.llm.queries import RULES, model_bytes
from test_pairs import brute_components
from test_texts import brute_quality, brute_spans

URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/1x?q", "https://sub.example.org/en/2#f", "http://notexample.org/es/", "http://org/", "http://org", "x.com/fr/", None, "",
        "http://b.com/de/9", "http://b.com/fr/9", "http://b.com:80/de/", "a://b://c/d", "http://com/fr/x/y", "http://x.net/\n/z?#"]


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def test_rules(spark):
    pages = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = [(i, u, "x", 1.0) for i, u in enumerate([*URLS, *pages, URLS[0]])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, purity double"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_url(rows[r["page_id"]][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_templates_learn_what_rules_say(spark):
    rules = [urls.Rule("block", "h.net", "/ads/1"), urls.Rule("allow", "h.net", "/news/1")]
    rows = [(f"http://h.net/{kind}/{n}/x", kind) for kind in ("ads", "news") for n in range(100, 300)] + [("http://z.net/a", None), (None, None)]
    frame = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(frame, rules).collect()}
    for i, (_, kind) in enumerate(rows[:-2]):
        assert got[i]["verdict"] == ("block" if kind == "ads" else "allow")
        assert got[i]["template"] == f"/{kind}/*/*"
    assert urls.judge_urls(frame, []).filter("verdict = 'block'").count() == 0
    assert urls.judge_urls(frame.filter("false"), rules).collect() == []


def test_small_and_deep_branches_stay_apart(spark):
    rules = [urls.Rule("allow", "h.net", "/fr/"), urls.Rule("block", "h.net", "/de/")]
    paths = [f"/fr/{i}" for i in range(980)] + [f"/de/{i}" for i in range(20)] + [f"/en/{i}" for i in range(1000)] + ["/en", "/", ""]
    frame = spark.createDataFrame([(i, f"http://h.net{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {r["path"]: r for r in urls.judge_urls(frame, rules).collect()}
    assert len(got) == len(paths) and got["/de/3"]["template"] == "/de/*" and got["/fr/3"]["template"] == "/fr/*"
    assert all(r["verdict"] == ("block" if p.startswith("/de/") else "allow") for p, r in got.items())
    deep = "/a/b/c/d/e/f/g/h/i/j"
    rules = [urls.Rule("block", "h.net", f"{deep}/ads/1"), urls.Rule("allow", "h.net", f"{deep}/news/1")]
    frame = spark.createDataFrame([(n, f"http://h.net{deep}/{kind}/{n}/x") for kind in ("ads", "news") for n in range(100, 300)], "page_id long, url string")
    for r in urls.judge_urls(frame, rules).collect():
        assert r["verdict"] == ("block" if "/ads/" in r["path"] else "allow")


def test_targets():
    sizes = {"a": 100, "b": 10, None: 1000, "c": 0}
    got = mixing.targets(sizes)
    # Weights 1, 2, 3 and 1 again; b and c stop at three times their size.
    assert got["b"] == 30 and got["c"] == 0
    assert sum(got.values()) == pytest.approx(1110) and got["a"] == 300 and got[None] == pytest.approx(780)


def test_mix(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 37) % 500) for i in range(6000)] + [(7, "s3", 259)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumnRenamed("x", "y")
    one = mixing.mix(frame.repartition(3))
    two = mixing.mix(frame.repartition(11, "doc_id"))
    a, b = [sorted(map(str, f.collect())) for f in (one, two)]
    assert a == b and len(a) == len(rows)
    goal = mixing.targets({s: sum(z for _, t, z in rows if t == s) for s in {t for _, t, _ in rows}})
    taken = {}
    for r in one.collect():
        assert 0 <= r["copies"] <= 3 and r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - g) <= 0.002 * g for s, g in goal.items())
    assert mixing.mix(frame.filter("false")).collect() == []


def test_flight_keeps_totals():
    import numpy as np

    draw = np.random.default_rng(1)
    sizes, chance = draw.integers(1, 300, 500).astype(float), np.full(500, 0.3)
    p = mixing.flight(sizes, chance, draw)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert p.sum() == pytest.approx(150) and p @ sizes == pytest.approx(chance @ sizes)
    mean = np.mean([mixing.flight(sizes, chance, draw) for _ in range(400)], axis=0)
    assert abs(mean - 0.3).max() < 0.12


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    stages, kept, odd = dict(corpus_pipeline.STAGES), [], docs.limit(1).selectExpr(*["cast(null as %s) as %s" % (t, c) for c, t in docs.dtypes])
    now = docs.unionByName(odd)
    for name in names[:-1]:
        now = spark.createDataFrame(stages[name](spark, now, SF).collect(), docs.schema)
        kept.append([tuple(r) for r in now.collect()])
        assert now.columns == docs.columns
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    good, distinct, clean, mixed = kept
    assert not any(brute_quality(t)[5] for _, t, *_ in good) and len(good) > 0.7 * len(original)
    assert all(original[d] == t for d, t, *_ in good + distinct)
    expected = sorted(int(d) for d, _, c in brute_components([(d, t) for d, t, *_ in good], 5) if d == c)
    assert sorted(d for d, *_ in distinct) == expected
    assert sorted(d for d, *_ in clean) == expected and not any(brute_spans(t) for _, t, *_ in clean)
    assert {d for d, *_ in mixed} <= set(expected) and max(sum(x[0] == d for x in mixed) for d in {x[0] for x in mixed}) <= 3
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    for r in stages["encoding"](spark, now, SF).collect():
        assert r["restored"] and len(r["ids"]) == r["n_tokens"]
    texts = {d: t for d, t, *_ in clean}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in stages["encoding"](spark, now, SF).collect())


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == [], name


def test_mixed_rows_are_whole(spark, tmp_path):
    """Null and repeated ids, null texts and working names that are taken already; table and frame agree."""
    rows = [(None if i % 5 == 0 else i % 40, f"s{i % 3}" if i % 7 else None, "w " * (i % 23) if i % 11 else None, i) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, _mix_at long")
    frame.repartition(3).write.parquet(f"{tmp_path}/t")
    goal = mixing.targets({s: sum(len((t or "").split()) for _, x, t, _ in rows if x == s) for s in {r[1] for r in rows}})
    by_at = {r[3]: r for r in rows}
    for docs in (frame, spark.read.parquet(f"{tmp_path}/t")):
        out = mixing.mixed_documents(docs)
        taken, times = {}, {}
        for r in out.collect():
            assert tuple(r) == by_at[r["_mix_at"]]
            times[r["_mix_at"]] = times.get(r["_mix_at"], 0) + 1
            taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
        assert out.columns == frame.columns and max(times.values()) <= 3
        assert all(abs(taken[s] - g) <= 23 for s, g in goal.items())


def test_working_tables_go_with_the_next_stage(spark, tmp_path):
    """They stay while the documents handed on still read them."""
    import os

    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    first = list(corpus_pipeline._working)
    assert first and all(os.path.isdir(p) for p in first)
    n = good.count()
    read = {p for p in first if any(os.path.basename(p) in f for f in good.inputFiles())}
    stages["near_dedup"](spark, good, SF)
    assert read and all(os.path.isdir(p) == (p in read) for p in first) and good.count() == n
    good.write.parquet(f"{tmp_path}/good")
    stages["secrets"](spark, spark.read.parquet(f"{tmp_path}/good"), SF)
    assert not any(os.path.isdir(p) for p in first)
