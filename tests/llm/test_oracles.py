import pytest

from strandmill.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
