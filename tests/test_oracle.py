"""Every catalogue query against its SQL on the smallest tables."""

import os

import pytest

from quarterline.catalog import all_queries  # noqa: F401
from quarterline.catalog.base import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = list(ORACLES)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert ok, note


def test_every_query_of_the_catalogue_has_sql():
    assert set(QUERIES) == set(ORACLES)
