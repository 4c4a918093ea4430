"""Every registered query against its SQL, in the default and in the split plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from checks.compare import difference, duckdb_rows
from tests.conftest import SMALL

NAMES = sorted(registered.report_queries())


def test_every_query_has_sql():
    assert set(registered.oracle_sql()) >= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    result = registered.queries()[name](spark, SMALL).toArrow()
    assert result.num_rows > 0
    assert difference(result, duckdb_rows(registered.oracle_sql()[name], SMALL)) is None


SPLIT = [
    "tube_summary",
    "order_summary",
    "order_summary_page",
    "routine_test_details",
    "micro_test_details",
    "report_group_details",
    "status_details",
    "patient_search_name",
    "patient_search_facility",
    "patient_search_sorted",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_plan_matches_sql(spark, every_group_is_large, name):
    result = registered.queries()[name](spark, SMALL).toArrow()
    assert difference(result, duckdb_rows(registered.oracle_sql()[name], SMALL)) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0
