"""The search among blocks by matrix products, against distances taken one by one."""

import time

import numpy as np
import pytest

from gleanery.operators import knn


def plain(queries, rows, k, allowed):
    out = []
    for i, q in enumerate(queries):
        total, shared = np.zeros(len(rows)), np.zeros(len(rows))
        for j in range(rows.shape[1]):
            d = q[j] - rows[:, j]
            total += np.where(np.isnan(d), 0.0, d * d)
            shared += ~np.isnan(d)
        ok = shared > 0 if allowed is None else (shared > 0) & allowed[i]
        d = np.sqrt(total * (rows.shape[1] / np.maximum(shared, 1)))
        out += [(i, n, d[n]) for n in sorted(np.flatnonzero(ok), key=lambda n: (d[n], n))[:k]]
    return out


@pytest.mark.parametrize("far", [0.0, 1e6])
@pytest.mark.parametrize("gaps", [0.0, 0.3, 1.0])
def test_products_find_the_rows_of_the_plain_search(far, gaps):
    rng = np.random.default_rng(7)
    for width in (1, 2, 5):
        rows = rng.integers(0, 3, (40, width)) + far + rng.choice([0.0, 1e-7, 0.25], (40, width))
        queries = np.concatenate([rows[:8], rng.normal(size=(4, width))])
        rows[rng.random(rows.shape) < gaps], queries[rng.random(queries.shape) < gaps / 2] = np.nan, np.nan
        for allowed in (None, rng.random((12, 40)) < 0.5):
            found = list(zip(*[a.tolist() for a in knn._Near(rows).find(queries, 4, allowed)]))
            want = plain(queries, rows, 4, allowed)
            assert [f[:2] for f in found] == [w[:2] for w in want]
            assert [f[2] for f in found] == pytest.approx([w[2] for w in want], rel=1e-12)


def test_a_block_of_wide_rows_takes_a_fraction_of_a_second():
    """It took 16 s coordinate by coordinate."""
    rng = np.random.default_rng(8)
    rows, queries = rng.normal(size=(4096, 64)), rng.normal(size=(4096, 64))
    start, near = time.perf_counter(), knn._Near(rows)
    found = [near.find(queries[i:i + 256], 7) for i in range(0, 4096, 256)]
    assert sum(len(f[0]) for f in found) == 4096 * 7
    assert time.perf_counter() - start < 8


def test_rows_of_one_file_are_searched_by_many_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(200).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) as x", "cast(id as double) as payload").coalesce(1).write.parquet(path)
    rows, written, plain_cut = spark.read.parquet(path), [], knn.cut
    monkeypatch.setattr(knn, "cut", lambda df: (written.append(df.rdd.getNumPartitions()), plain_cut(df))[1])
    knn.nearest(rows, rows.select("id", "x"), 3, 2).collect()
    assert written[-1] > 1  # the queries, on their way to the blocks
