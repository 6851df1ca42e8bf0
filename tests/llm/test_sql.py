import pytest
from oracle import compare

from strataweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")
