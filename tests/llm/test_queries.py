"""Every registered text query runs on the smallest table; those with SQL agree with it."""
import pytest

from catalog.check import compare, oracle_connection
from soundings.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    problem, _, _ = compare(spark, oracle_connection(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert problem is None, problem


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
