import pytest
from oracle import DATA, actual, expected

from graphloom.jobs import answer_queries, source_queries  # noqa: F401  register their queries with the others
from graphloom.jobs.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    names, rows = actual(QUERIES[name](spark, DATA))
    want_names, want = expected(ORACLES[name])
    assert names == want_names
    assert len(rows) == len(want) > 0
    assert rows == want
