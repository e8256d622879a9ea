"""Every registered query with SQL must give the rows DuckDB gives."""

import pytest
from check import compare, duck
from conftest import SF

from mapwright.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    problems = [p for p in compare(catalog.queries()[name](spark, SF), con, ORACLES[name]) if p != "no rows"]
    assert not problems


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(catalog.queries())
