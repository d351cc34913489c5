"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import pandas as pd
import pytest

import __spark_entry__ as entry_points
from conftest import SF

#: Models at their full presets take minutes each; ``tools/check.py`` compares them, two of each kind are compared here too.
LONG = {n for n in entry_points.oracle_sql() if n.startswith(("clf_", "reg_", "txt_")) or n in (
    "leaderboard", "analyze_leaderboard", "shap_tree", "shap_sampled", "permutation_importance", "promote_model", "clu_kmeans_sweep")}
SHORT = {"clf_logistic", "clf_random_forest", "clf_gaussian_nb", "clf_knn", "reg_knn", "reg_linear", "reg_ridge", "reg_lasso", "reg_elastic_net",
         "reg_decision_tree", "txt_tfidf_complement_nb", "shap_tree"}
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("∅" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r)
                           for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG | SHORT))
def test_matches_sql(spark, tables, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(tables.execute(SQL[name]).df())


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["analyze_series"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
