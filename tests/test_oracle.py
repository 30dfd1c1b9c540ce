import pytest

import __spark_entry__ as entry
from check_oracle import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) == ""


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["o_orderkey", "price", "Hasprice"] and found.count() > 0


# Iterative fits and file bytes; their parts are checked in test_modelling and test_workspace.
WITHOUT_SQL = {
    "train_logistic", "train_random_forest", "train_decision_tree", "train_knn", "compare_models_reg", "compare_models_class",
    "feature_importance", "file_signatures",
}


def test_only_known_queries_have_no_sql():
    own = {n for n, f in entry.queries().items() if f.__module__.startswith("gridwright.plans")}
    assert own - set(entry.oracle_sql()) == WITHOUT_SQL


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
