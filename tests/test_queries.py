"""A cross-section of the registered queries against the check engine; tests/harness.py runs all of them."""
import harness
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
PICKED = ["A0_flagship_growth_leaders", "K1_fact_upsert", "K2_company_upsert", "K17_refetch_plan", "S2_numeric_facts", "S5_company_facts", "F4_universe_decision",
          "J11_nearest_date", "R4_one_value", "R6_consistent_quarters", "R11_carry_forward", "L11_total_debt", "W1_trailing_year", "A2_median_absolute_deviation",
          "G11_total_score", "V2_refusal_reason", "D5_derived_markers"]


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF_DIR)


@pytest.mark.parametrize("name", PICKED)
def test_query_agrees(spark, con, name):
    ok, message = harness.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, message


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
