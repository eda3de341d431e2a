"""The driver contract: every registered query equals its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from oracle.queries import oracle_sql as base_sql
from oracle_check import connect, difference
from zonecast.plans.catalog import QUERIES

SQL = entry.oracle_sql()
FITTED = {
    "model_predictions", "model_leaderboard", "feature_importance", "leading_features", "feature_descriptions",
    "search_results", "ensemble_results", "model_recommendations", "attribution_summary",
}


@pytest.fixture(scope="module")
def engine():
    return connect(SF_DIR)


def test_only_fitted_models_have_no_twin():
    assert set(QUERIES) - set(base_sql()) == FITTED and set(base_sql()) <= set(QUERIES)
    assert set(SQL) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, engine, name):
    assert difference(entry.queries()[name](spark, SF_DIR), engine, SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 16 and len(df.columns) == 38
