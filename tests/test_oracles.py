"""Every registered query with SQL against DuckDB on the smallest tables; the others for rows."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
SLOW = {"best_model", "cv_f1", "cv_f1_boosted", "feature_importance", "forest_regression", "gbt_classifier"}  # tree fits, see test_models


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_fitted_models_return_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["entity", "archetype"] and df.count() > 0
