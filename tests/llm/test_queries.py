"""Corpus queries against SQL, where SQL can express them, on the smallest tables."""

import pytest

from strataloom.llm import queries as q

from ..compare import connect, same


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(q.QUERIES[name](spark, sf_dir), connect(sf_dir), q.ORACLES[name])
