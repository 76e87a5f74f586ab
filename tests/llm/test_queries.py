import pytest

from quillmap.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, con, name):
    assert not differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
