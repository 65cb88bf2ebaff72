import pytest

from tests.oracle import compare
from textloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name])
