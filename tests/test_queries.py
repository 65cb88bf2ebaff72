"""Every registered query against its SQL, or for its properties where SQL can't say it."""

import pytest
from textloom import plans

from tests.oracle import DATA, compare

ROWS_ONLY = sorted(set(plans.QUERIES) - set(plans.ORACLES))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, name, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_whitened_counts_have_unit_covariance(spark):
    for row in plans.QUERIES["m11_whiten"](spark, DATA).collect():
        assert abs(row["value"] - (row["x"] == row["y"])) < 1e-5
