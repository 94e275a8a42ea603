"""Every registered query gives the rows of its SQL."""

import pytest
from oracle import compare

from notewright.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0
