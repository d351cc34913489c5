"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from conftest import SF
from gleanery.llm import overlap
from gleanery.llm.queries import _NGRAM_SQL
from test_pairs import SCHEMA, brute_components, got_components, planted


def chains(seed=8):
    """Chains of texts in which only neighbours are similar, under a passage that all share, and short texts from few words."""
    draw = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(40))
    rows = []
    for c in range(12):
        words = [f"c{c}w{i}" for i in range(130)]
        for step in range(9):
            rows.append((len(rows), " ".join(words) + " " + passage))
            for _ in range(2):
                words[draw.randrange(130)] = f"new{len(rows)}x{draw.random()}"
    rows += [(1000 + i, " ".join(draw.choices("abc", k=draw.randint(1, 9)))) for i in range(150)]
    rows += [(2000 + i, passage + f" tail{i % 7} end{i}") for i in range(60)]
    return rows


def test_sql_is_the_contract():
    assert all(x in _NGRAM_SQL for x in ("len(w) < 4", "w[i:i + 3]", "100 * k >= 85 *")) and "80" not in _NGRAM_SQL and "kept" not in _NGRAM_SQL


@pytest.mark.parametrize("frequent", [0, 1 << 20])
@pytest.mark.parametrize("block, short", [(256, 8), (16, 2)])
def test_components(spark, monkeypatch, block, short, frequent):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "SHORT_LIST", short)
    rows = planted(400) + [(50_000 + d, t) for d, t in chains()]
    frame = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA).repartition(5)
    assert got_components(overlap.ngram_components(frame, overlap.Join(frequent=frequent))) == brute_components(rows, 4, 85)


def test_smallest_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got_components(overlap.ngram_components(docs)) == brute_components(rows, 4, 85)


def test_no_documents_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b c d e", 5, "x"), (2, "A b c d e", 6, "y"), (None, None, 1, "z")], "doc_id long, text string, node long, item string")
    assert got_components(overlap.ngram_components(frame)) == [("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None")]
    assert overlap.ngram_components(frame.filter("false")).collect() == []


def test_search_finds_what_brute_force_finds():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for i in range(150):
        own = base.copy()
        hit = draw.random(200) < draw.choice([0.01, 0.05, 0.1, 0.3])
        own[hit] = draw.integers(0, 1 << 60, int(hit.sum()))
        sets.append(np.unique(own[:draw.integers(1, 201) if i % 5 == 0 else 200]))
    for how in (overlap.Join(), overlap.Join(percent=60), overlap.Join(percent=99)):
        lists = overlap.Lists(sets, how)
        for probe in sets[::7]:
            both = [len(np.intersect1d(probe, s)) for s in sets]
            expected = [i for i, (s, b) in enumerate(zip(sets, both)) if 100 * b >= how.percent * (len(s) + len(probe) - b)]
            assert sorted(lists.search(probe).tolist()) == expected


def test_heap_merge_counts():
    draw = random.Random(1)
    for _ in range(200):
        lists = [sorted(draw.sample(range(40), draw.randint(1, 30))) for _ in range(draw.randint(1, 12))]
        need = draw.randint(1, 8)
        expected = [(m, n) for m in range(40) if (n := sum(m in x for x in lists)) >= need]
        assert list(overlap.merge_skip(lists, need)) == expected


def test_parities_bound_the_difference():
    draw = np.random.default_rng(2)
    for n in (1, 50, 500, 530, 3000, 8000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], draw.integers(0, 1 << 63, n // 2 + n // 10).astype(np.uint64)]))
        one, two = overlap.parities(a), overlap.parities(b)
        if len(one) != len(two):
            one, two = (overlap.folded(one), two) if len(one) > len(two) else (one, overlap.folded(two))
        assert np.bitwise_count(one ^ two).sum() <= len(np.setxor1d(a, b))


def test_similar_sets_have_parities_that_compare():
    sizes = [len(overlap.parities(np.arange(n, dtype=np.uint64))) for n in range(1, 5000)]
    for n in range(1, 4000):
        m = min(100 * n // 85, 4999)
        assert sizes[m - 1] in (sizes[n - 1], 2 * sizes[n - 1])
