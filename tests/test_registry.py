"""Every registered query against its SQL check on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_points.REGISTRY))
def test_query_matches_check(spark, engine, name):
    df = entry_points.queries()[name](spark, SF)
    fine, detail = compare(engine, df, entry_points.oracle_sql()[name])
    assert fine, detail


def test_entry_reads_the_given_tables(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["source", "total", "per_second"]
    assert df.count() > 0
