"""Each registered query against its DuckDB statement on the same tables, exact values."""

import os

import pytest

from oracles import ORACLES
from tests.harness import compare, connect
from tillscope.plans.registry import QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, ROOT), con, ORACLES[name]) == []
