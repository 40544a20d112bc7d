"""The corpus queries that SQL can express equal their oracles on the smallest tables."""

import pytest
from compare import connection, same

from lexiforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(name, spark, small):
    same(queries.queries()[name](spark, small), connection(small), queries.oracle_sql()[name])


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n != "pipeline")
    assert numbers == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())
