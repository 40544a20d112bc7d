"""Every query with an oracle equals it on the smallest tables; tests/test_results.py has the others."""

import pytest
from compare import connection, same

from lexiforge import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(name, spark, small, con):
    same(QUERIES[name](spark, small), con, ORACLES[name])


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
