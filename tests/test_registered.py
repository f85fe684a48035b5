"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from caselink.plans import catalog, oracle
from compare import connect, differences
from conftest import SMALL

# Trained models have no SQL; these have property tests in test_linkage.
TRAINED = {
    "train_ensemble",
    "feature_importances",
    "score_pairs",
    "model_roundtrip",
    "ranked_cases",
    "compare_models",
    "compare_models_served",
}
QUERIES = catalog.QUERIES
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_all_other_queries_have_sql():
    assert set(QUERIES) - set(SQL) == TRAINED
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert differences(duck, QUERIES[name](spark, SMALL), SQL[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
