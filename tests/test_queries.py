"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import os

import check
import pytest

import __spark_entry__ as driver
from corpusloom.workload.registry import load

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return check.duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert check.compare(spark, con, name, QUERIES[name], SMALL) is None


def test_driver_contract(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and set(driver.oracle_sql()) <= set(driver.queries())
