"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from check import compare, connect
from seqloom.plans.catalog import load

SF = "/root/testdata/sf0.001"
CATALOG = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is not None])
def test_query_equals_sql(spark, con, name):
    message, n, _, _ = compare(spark, con, CATALOG[name], SF)
    assert message == "" and n > 0


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is None])
def test_query_has_rows(spark, con, name):
    assert compare(spark, con, CATALOG[name], SF)[1] > 0
