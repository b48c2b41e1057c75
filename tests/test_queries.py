"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from tidegauge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    compare.same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)


def test_every_query_has_sql_and_none_is_stray():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "hour", "n", "lag_1", "lag_24", "trailing_24"] and df.count() > 0
