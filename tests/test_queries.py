"""Every query with a SQL twin gives the twin's rows; the others run and have rows."""

import pytest

from quantloom.plans import ORACLES, QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
