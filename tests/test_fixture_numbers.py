"""Totals recorded in FIXTURES.md, which leave out the sign-up rows."""

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from footfall.operators.cohort import cohort_retention
from footfall.operators.funnel import (
    funnel_overall,
    funnel_step_counts,
    funnel_summary,
    funnel_users,
)
from footfall.operators.kpi import kpi_daily
from footfall.operators.sessions import session_steps, sessionize
from footfall.sources.adapters import order_events, shop_events

SF = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def shop(spark):
    return shop_events(spark, SF).filter("event_type <> 'signup'")


def test_sessions(shop):
    counts = sessionize(shop).agg(
        F.count("*"),
        F.countDistinct("calculated_session_id"),
        F.countDistinct("effective_session_id"),
    )
    assert tuple(counts.first()) == (7983, 7685, 4964)


@pytest.mark.parametrize("source", [lambda df: df, sessionize], ids=["raw", "sessionized"])
def test_funnel(shop, source):
    row = funnel_step_counts(session_steps(source(shop))).first()
    assert tuple(row)[:6] == (150, 119, 25, 1738, 217, 26)
    assert (row.avg_ttb_seconds, row.median_ttb_minutes) == (28487.32, 432.75)


def test_per_instant_funnel_reaches_no_cart(shop):
    row = funnel_overall(session_steps(shop, per_instant=True)).first()
    assert tuple(row)[:3] == (150, 0, 0)
    assert row.cr_cart_to_purchase_pct is None and row.avg_ttb_minutes is None


def test_unordered_funnel(shop):
    assert tuple(funnel_users(shop).first()) == (150, 150, 150)


@pytest.mark.parametrize("source", [lambda df: df, sessionize], ids=["raw", "sessionized"])
def test_kpi(shop, source):
    row = kpi_daily(source(shop)).agg(
        F.count("*"), F.sum("dau"), F.sum("total_orders"), F.sum("total_revenue").cast("string")
    )
    assert tuple(row.first()) == (30, 3716, 1981, "95455.77")


@pytest.mark.parametrize("source", [lambda df: df, sessionize], ids=["raw", "sessionized"])
def test_funnel_summary(shop, source):
    row = funnel_summary(source(shop)).agg(
        F.count("*"),
        F.sum("view_users"),
        F.sum("cart_users"),
        F.sum("purchase_users"),
        F.countDistinct("top_category"),
        F.countDistinct("brand"),
    )
    assert tuple(row.first()) == (2590, 1617, 430, 123, 7, 26)


def test_weekly_cohorts_of_orders(spark):
    row = cohort_retention(order_events(spark, SF), "W").agg(
        F.countDistinct("cohort_group"),
        F.count("*"),
        F.sum("active_users"),
        F.max("cohort_index"),
        F.round(F.sum("retention_rate"), 2),
    )
    assert tuple(row.first()) == (151, 10061, 14765, 343, 128257.62)


@pytest.mark.parametrize("granularity, rows", [("D", 13944), ("W", 10061), ("M", 1845)])
def test_order_cohort_rows(spark, granularity, rows):
    assert cohort_retention(order_events(spark, SF), granularity).count() == rows


@pytest.mark.parametrize(
    "granularity, event_filter, rows",
    [("D", None, 82), ("W", None, 5), ("M", None, 1), ("D", "purchase", 210)],
)
def test_shop_cohort_rows(shop, granularity, event_filter, rows):
    assert cohort_retention(shop, granularity, event_filter).count() == rows
