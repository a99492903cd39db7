"""Every registered query against its SQL in an independent engine."""

import pytest
from compare import SMALL, connect, difference

import __spark_entry__ as entry_point
from salesloom.operators import training

SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def registered(spark):
    """The queries; their models have few trees here, which no statement depends on."""
    whole = [(p, p["trees"]) for p in (training.URGENCY_PARAMS, training.PRIORITY_PARAMS, training.PROFIT_PARAMS)]
    for params, _ in whole:
        params["trees"] = 3
    yield entry_point.queries()
    for params, trees in whole:
        params["trees"] = trees


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_statement_has_a_query(registered):
    assert set(SQL) <= set(registered)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, registered, db, name):
    assert difference(registered[name](spark, SMALL), db, SQL[name]) is None


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_items"] == 6000
