"""Core queries against their SQL at the smallest size."""

import pytest
from conftest import SF
from oracle import assert_same, connect

from codeweft.catalogue import CORE

@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_equals_sql(spark, con, name):
    assert_same(CORE.queries[name](spark, SF), con, CORE.sql[name])
