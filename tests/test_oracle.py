"""Queries against their SQL. CHECK_ALL=1 compares every one, else a selection."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract
from lodgeframe.plans.catalog import QUERIES
from lodgeframe.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SELECTION = """clean_bookings detect_outliers suppress_outliers_two_sided classify_columns
    correlation_matrix describe upsert_by_id dynamic_aggregate nested_terms date_histogram
    search search_score report_cancellation_rate report_adr_by_month report_revenue
    report_repeat_guests full_text_search full_text_score fuzzy_terms suggest""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("CHECK_ALL") else SELECTION)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_the_contract_registers_them_all():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
