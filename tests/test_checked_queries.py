"""Every query with check SQL against DuckDB, over whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point
from shoplight.plans.catalog import all_queries
from tests.harness import connect, differences

ROOT = f"/root/testdata/sf{os.environ.get('SHOPLIGHT_TEST_SF', '0.01')}"
QUERIES = {name: entry_point.queries()[name] for name in all_queries()}
CHECKS = {name: sql for name, sql in entry_point.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_agrees_with_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, ROOT), duck, CHECKS[name]) == []


def test_every_query_is_checked():
    assert set(QUERIES) == set(CHECKS)


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 20
