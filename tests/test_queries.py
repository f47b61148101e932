"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
import oracle
from docweave.plans.oracles import ORACLES
from docweave.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    rows = entry_points.queries()[name](spark, SF_DIR)
    assert oracle.difference(con, rows, entry_points.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
