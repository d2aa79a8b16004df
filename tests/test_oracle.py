"""Every query with SQL against DuckDB over the smallest tables."""

import pytest
from oracle import compare, duck

from leadtide import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""
