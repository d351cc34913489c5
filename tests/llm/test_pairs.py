"""Near-duplicates and top-k search against brute force."""

import random

import numpy as np
import pytest

from conftest import SF
from gleanery.llm import dedup, topk

SCHEMA = "doc_id long, text string, kept string"


def brute_components(rows, words, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def got_components(frame):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in frame.collect())


def planted(n=700, seed=3):
    """A base text that only its light copies resemble, copies of copies, exact copies, and odd rows."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [draw.choice(vocabulary) for _ in range(60)]
    rows = [(10_000, " ".join(base))]
    for i in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(60)] = draw.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(20_000 + i, rows[5][1]) for i in range(40)]
    rows += [(30_000 + i, " ".join(draw.choice(vocabulary) for _ in range(40))) for i in range(60)]
    rows += [(1, rows[2][1]), (1, rows[2][1]), (None, rows[2][1]), (None, "only here"), (40_000, None), (40_001, ""), (40_002, " \n\t "),
             (40_003, "Solo"), (40_004, "sOLO"), (40_005, "x y"), (40_006, "X\u000bY"), (40_007, "É é"), (40_008, "é é")]
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_components_of_a_hot_group(spark, words):
    rows = planted()
    frame = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA).repartition(7)
    assert got_components(dedup.near_duplicates(frame, dedup.MinHash(words=words))) == brute_components(rows, words)


def test_components_of_the_smallest_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got_components(dedup.near_duplicates(docs, dedup.MinHash(words=2))) == brute_components(rows, 2)


def test_one_of_each_stays(spark):
    rows = planted(60)
    frame = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA)
    left = dedup.keep_one_of_each(frame)
    assert left.columns == frame.columns
    expected = sorted({d for d, _, c in brute_components(rows, 5) if d == c and d != "None"})
    assert sorted(str(r["doc_id"]) for r in left.filter("doc_id is not null").collect()) == expected


def test_rows_that_share_an_id_or_have_none(spark):
    """Different texts under no doc_id or one stay, copies go, whatever else the id stands for."""
    def text(name):
        return " ".join(f"{name}{i}" for i in range(30))

    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c").upper()), (2, text("d")), (2, text("e")), (2, text("a")),
            (3, text("d") + " more"), (None, None), (None, ""), (None, None), (4, None), (4, None), (4, "")]
    left = dedup.keep_one_of_each(spark.createDataFrame([(*r, "other") for r in rows], SCHEMA).repartition(4))
    got = sorted((str(r["doc_id"]), str(r["text"]).lower()) for r in left.collect())
    assert got == sorted([("1", text("a")), ("None", text("b")), ("None", text("c")), ("2", text("d")), ("2", text("e")),
                          ("None", "none"), ("None", ""), ("None", "none"), ("4", "none"), ("4", "")])


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.near_duplicates(empty).collect() == []
    assert dedup.keep_one_of_each(empty).collect() == []


def test_estimate_is_near_the_similarity(spark):
    how, hashes = dedup.MinHash(words=1), dedup.Hashes()
    a, b = [" ".join(f"t{i}" for i in range(s, s + 300)) for s in (0, 40)]
    rows = [[int(v) for v in dedup.packed(dedup.minima(dedup.shingle_set(t, 1, hashes), *how.families()), how.bits).view(np.int64)] for t in (a, b)]
    got = spark.createDataFrame([tuple(rows)], "a array<long>, b array<long>").select(dedup.similarity_estimate("a", "b", how)).first()[0]
    assert abs(got - 260 / 340) < 0.12


def brute_top(rows, k):
    ok = [(i, v, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, _, x) in enumerate(ok):
        if q % 5 == 0:
            scores = sorted((-int(x @ y), i) for m, (i, _, y) in enumerate(ok) if m != n and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_over_many_shards(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(draw.normal(size=6))]) for i in range(600)]
    rows += [(700 + i, [0.5] * 6) for i in range(150)] + [(700, [0.5] * 6), (5, rows[5][1])]
    rows += [(900, None), (905, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (910, [float("nan")] * 6), (915, [float("inf")] * 6), (920, []), (None, [1.0] * 6), (925, [1.0, 2.0]), (930, [3.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    from gleanery.session import cut
    vectors = cut(topk.vectors_of(frame, "vec_id", "embedding"))
    got = topk.top_k(vectors, vectors.filter("vec_id % 5 = 0"), k=4, shard_rows=100)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 4)
    empty = vectors.filter("false")
    assert topk.top_k(empty, empty).collect() == []
    assert topk.top_k(vectors, empty).collect() == []


def test_rows_of_a_table_need_no_copy(spark, tmp_path):
    """Parquet rows are named by file and place; names of working columns may be taken already."""
    from gleanery.llm.common import numbered
    from gleanery.session import owning

    rows = [(None, "one two three four five six seven", "a"), (None, "eight nine ten eleven twelve", "b"), (1, "one two three four five six seven", "c"),
            (2, None, "d"), (2, None, "e"), (3, "", None), (1, "other words under the same id here", "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _dedup_row string").selectExpr("*", "_dedup_row as _dedup_at", "'en' as lang", "'s' as source")
    frame.repartition(3).write.parquet(f"{tmp_path}/t")
    table, written = spark.read.parquet(f"{tmp_path}/t"), []
    with owning(written):
        known, names = numbered(table, "_dedup")
        assert written == [] and names == ["_dedup_file", "_dedup_at_"]
        assert known.select(*names).distinct().count() == len(rows)
        other, names = numbered(table.filter("true"), "_dedup")
        assert len(written) == 1 and other.select(*names).distinct().count() == len(rows)
    for source in (table, frame):
        left = dedup.keep_one_of_each(source)
        assert left.columns == table.columns
        got = sorted((r["doc_id"] or 0, r["_dedup_row"] or "") for r in left.collect())
        assert got in ([(0, "b"), (1, "c"), (1, "f"), (2, "d"), (3, "")], [(0, "b"), (1, "c"), (1, "f"), (2, "e"), (3, "")])
