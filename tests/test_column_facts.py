"""Facts about the columns of a table that one task scans are gathered by many tasks."""

import pytest

from gleanery.operators import infer


@pytest.mark.parametrize("facts", [infer.target_statistics, infer.detect_text])
def test_rows_of_one_file_are_dealt_out(spark, tmp_path, facts):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id", "concat('word ', id % 7) as text").coalesce(1).write.parquet(path)
    out = facts(spark.read.parquet(path))
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: (r["n_values"], r["n_unique"]) for r in out.collect()} == {"id": (100, 100), "text": (100, 7)}


@pytest.mark.parametrize("facts", [infer.target_statistics, infer.detect_text])
def test_no_row_is_multiplied_by_the_columns(spark, facts):
    """Each column is counted by itself; facts are those of all values, odd ones included."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.sql("""SELECT id, CASE id % 5 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') WHEN 3 THEN 1.5D END AS real, timestamp_seconds(1698537600 + 1800 * (id % 8)) AS at,
            CASE id % 4 WHEN 0 THEN repeat('long text ', 9) WHEN 1 THEN '  ' WHEN 2 THEN 'two words' END AS text, id % 2 = 0 AS flag, date'2024-01-01' AS day, array(id % 3) AS list FROM range(40)""")
        out = facts(rows)
        assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r["column"]: r for r in out.collect()}
        as_text = facts is infer.detect_text
        for c in rows.columns:
            v = rows.selectExpr(f"CAST({c} AS STRING) AS v" if as_text else f"{c} AS v").filter("v IS NOT NULL")
            assert (got[c]["n_values"], got[c]["n_unique"]) == (v.count(), v.selectExpr("count(DISTINCT v)").first()[0]), c
            if as_text:
                assert got[c]["avg_len"] == pytest.approx(v.selectExpr("avg(length(v))").first()[0])
        if as_text:
            assert got["text"]["avg_words"] == pytest.approx((18 + 0 + 2) / 3) and got["real"]["n_unique"] == 4
        else:
            assert [got[c]["whole"] for c in ("id", "real", "flag", "text")] == [True, False, True, False]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
