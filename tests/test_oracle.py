import pytest

import __spark_entry__ as entry
from marginlake.plans.oracle import ORACLE
from marginlake.plans.queries import QUERIES
from tests.oracle_check import compare, sql_connection


@pytest.fixture(scope="module")
def con(sf):
    return sql_connection(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], sf) is None


def test_flagship_entry(spark):
    assert entry.entry(spark).count() == 2364
