"""Every registered query of the library against its oracle, or for its rows."""

import pytest

import __spark_entry__
from lodestrata.plans import catalog
from tests.oracle import SF, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
