"""Every registered query equals its SQL twin on the small stored tables."""

import pytest

from folioscope.plans.all import QUERIES, SQL
from tests.compare import TESTDATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, TESTDATA) == ""


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
