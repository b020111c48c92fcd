"""The text queries against their SQL; those without SQL must run."""

import pytest

from loomline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, compare):
    compare(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
