"""Every registered query equals its SQL on the provided tables, cell by cell."""

import re

import pytest
from compare import connect, difference
from conftest import TESTDATA

import __spark_entry__ as contract

SF = f"{TESTDATA}/sf0.01"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


OWN = [n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)]


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 1 and rows[0].step_1_view_users > 0


@pytest.mark.parametrize("name", ["valid_events", "rejected_events"])
def test_validation_splits_off_a_good_share(spark, name):
    assert QUERIES[name](spark, SF).count() > 300


def test_every_rule_is_broken_by_some_row(spark):
    from footfall.sources.validation import rules

    broken = ",".join(r.failed_rules for r in QUERIES["rejected_events"](spark, SF).collect())
    assert set(broken.split(",")) == set(rules()) - {"event_time_length"}


@pytest.mark.parametrize(
    "matrix, flat", [("cohort_counts_matrix", "cohort_month"), ("cohort_chart", "cohort_week")]
)
def test_no_cell_of_a_matrix_is_lost(spark, matrix, flat):
    assert QUERIES[matrix](spark, SF).count() == QUERIES[flat](spark, SF).count()
