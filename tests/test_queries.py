"""Every query that has SQL gives the SQL's rows; the others give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from lattiq.plans import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    left, right = oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert left == right
    assert left or name == "group_contrast"  # no group is large enough on the smallest tables
    spark.catalog.clearCache()


#: Hundreds of runs or jobs; test_benchmark.py and test_community.py take their parts.
LONG = {"benchmark_grid", "benchmark_shares", "diagnosis_grid", "spot_communities"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
