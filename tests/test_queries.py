"""Every registered query with an SQL twin, value by value, at the small scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_mod  # noqa: E402
from check_queries import compare, duck  # noqa: E402

QUERIES, ORACLE = entry_mod.queries(), entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_each_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf, name):
    note, _, _, ok = compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"stream_equals_batch"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_mod.entry(spark).count() == 10
