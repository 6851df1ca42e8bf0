import pytest
from oracle import compare

from strataweave.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, core.queries()[name], core.oracle_sql()[name], "/root/testdata/sf0.01") > 0


def test_entry(spark):
    assert core.entry(spark).count() > 0
