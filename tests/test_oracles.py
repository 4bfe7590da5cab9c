"""Every query with a SQL equivalent against DuckDB, over whole tables."""

import pytest
from compare import connect, difference
from conftest import DATA

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    assert difference(df, duck.sql(contract.oracle_sql()[name])) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 200  # documents without comments are posts without votes


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
