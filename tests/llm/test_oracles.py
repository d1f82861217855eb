import pytest

from talkgrid.llm.queries import ORACLES, QUERIES
from tests.oracle import differ


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert differ(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLES[name]) == ""
