"""Every model query against the same computation in SQL, on the smallest tables."""

import pytest

from strataloom.plans import edit_queries, source_queries  # noqa: F401
from strataloom.plans import queries as q

from .compare import connect, same


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    same(q.QUERIES[name](spark, sf_dir), connection, q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert q.QUERIES[name](spark, sf_dir).count() > 0
