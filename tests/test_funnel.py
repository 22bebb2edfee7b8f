import random
import statistics

import pytest
from pyspark.sql import functions as F

from footfall.functions.median import total_and_median
from footfall.functions.rates import mean_of_rounded, money_per, pct
from footfall.operators.funnel import (
    funnel_overall,
    funnel_step_counts,
    funnel_summary,
    funnel_users,
    funnel_users_rates,
    session_funnel,
)
from footfall.operators.sessions import session_steps, sessionize


def reached(df):
    r = session_funnel(session_steps(df)).first()
    return r.reached_view, r.reached_cart, r.reached_purchase, r.ttb_seconds


def day_of(*steps, **kw):
    return [dict(event_type=t, event_time=f"2024-01-01 {m}", **kw) for t, m in steps]


def test_order_is_by_first_occurrence(make_events):
    rows = day_of(("cart", "10:00"), ("view", "10:01"), ("cart", "10:02"))
    assert reached(make_events(*rows)) == (1, 0, 0, None)


def test_purchase_without_cart_has_time_to_buy(make_events):
    rows = day_of(("view", "10:00"), ("purchase", "10:01:30.5"))
    assert reached(make_events(*rows)) == (1, 0, 0, 90.5)


def test_same_instant_counts_as_in_order(make_events):
    rows = day_of(("view", "10:00"), ("cart", "10:00"), ("purchase", "10:00"))
    assert reached(make_events(*rows)) == (1, 1, 1, 0.0)


def test_purchase_before_cart(make_events):
    rows = day_of(("view", "10:00"), ("purchase", "10:01"), ("cart", "10:02"))
    assert reached(make_events(*rows)) == (1, 1, 0, 60.0)


def test_shared_session_id_is_one_session_of_two_users(make_events):
    rows = [
        row
        for user in (1, 2)
        for row in day_of(("view", "10:00"), ("cart", "10:01"), user_id=user, user_session="x")
    ]
    row = funnel_step_counts(session_steps(make_events(*rows))).first()
    assert tuple(row)[:6] == (2, 2, 0, 1, 1, 0)
    assert row.avg_ttb_seconds is None and row.median_ttb_seconds is None


def test_frontend_session_may_span_a_gap(make_events):
    rows = day_of(("view", "08:00"), ("cart", "18:00"), ("purchase", "18:30"), user_session="x")
    row = funnel_overall(session_steps(make_events(*rows))).first()
    assert tuple(row)[:3] == (1, 1, 1)
    assert row.avg_ttb_minutes == row.median_ttb_minutes == 630.0


def test_zero_denominators_are_null(make_events):
    row = funnel_overall(session_steps(make_events(*day_of(("cart", "10:00"))))).first()
    assert tuple(row)[:3] == (0, 0, 0)
    assert set(tuple(row)[3:]) == {None}


def test_no_events_at_all(make_events):
    empty = make_events(dict(event_time="2024-01-01")).limit(0)
    assert tuple(funnel_overall(session_steps(empty)).first())[:3] == (0, 0, 0)
    assert tuple(funnel_users(empty).first()) == (0, 0, 0)


def test_conversion_and_dropoff_add_up(make_events):
    path = [("view", "10:00"), ("cart", "10:01"), ("purchase", "10:02")]
    rows = [
        row
        for user in range(7)
        for row in day_of(*path[: 1 + user % 3], user_id=user)
    ]
    row = funnel_overall(session_steps(make_events(*rows))).first()
    assert row.step_1_view_users >= row.step_2_cart_users >= row.step_3_purchase_users
    assert row.cr_view_to_cart_pct + row.dropoff_view_to_cart_pct == pytest.approx(100, abs=0.01)
    overall = row.overall_conversion_rate_pct + row.overall_dropoff_rate_pct
    assert overall == pytest.approx(100, abs=0.01)


def test_top_category_and_brand_names(make_events):
    rows = [
        dict(event_time="2024-01-01", user_id=i, category_code=c, brand=b)
        for i, (c, b) in enumerate([(None, None), ("", "b"), ("a.b", "b"), ("abc", "b")])
    ]
    summary = funnel_summary(make_events(*rows))
    names = {(r.top_category, r.brand) for r in summary.collect()}
    assert names == {("uncategorized", "unknown"), ("", "b"), ("a", "b"), ("abc", "b")}
    assert summary.filter("cr_cart_to_purchase_pct IS NOT NULL").count() == 0


@pytest.mark.parametrize("source", [lambda df: df, sessionize], ids=["raw", "sessionized"])
def test_summary_steps_must_meet_in_one_day_and_category(make_events, source):
    rows = [
        dict(event_time="2024-01-01 23:55", category_code="a", user_session="s"),
        dict(event_time="2024-01-02 00:05", category_code="a", user_session="s", event_type="cart"),
        dict(event_time="2024-01-01 23:56", category_code="b", user_session="s", event_type="cart"),
        dict(event_time="2024-01-01 23:57", category_code="c", user_session="s", event_type="cart"),
        dict(event_time="2024-01-01 23:58", category_code="c", user_session="s"),
    ]
    got = {
        (str(r.event_date), r.top_category): (r.view_users, r.cart_users, r.cart_sessions)
        for r in funnel_summary(source(make_events(*rows))).collect()
    }
    assert got == {
        ("2024-01-01", "a"): (1, 0, 0),
        ("2024-01-02", "a"): (0, 0, 0),
        ("2024-01-01", "b"): (0, 0, 0),
        ("2024-01-01", "c"): (1, 1, 1),
    }


def test_all_time_funnel_ignores_order_and_session(make_events):
    rows = [
        dict(event_time="2024-01-01", event_type="purchase"),
        dict(event_time="2024-02-01", event_type="view"),
        dict(event_time="2024-03-01", event_type="cart", user_id=2),
    ]
    row = funnel_users_rates(funnel_users(make_events(*rows))).first()
    assert tuple(row)[:3] == (1, 1, 1)
    assert row.cr_view_to_cart_pct == 100.0 and row.dropoff_cart_to_purchase_pct == 0.0


def counts_frame(spark, values):
    return spark.createDataFrame([(v, 1) for v in values], "v bigint, n bigint")


@pytest.mark.parametrize(
    "values",
    [
        [5],
        [1, 2],
        [1, 10**12],
        [3, 3, 3, 9],
        [0, 2**21 - 1, 2**21, 2**21 + 1],
        [2**42 - 1, 2**42, 2**42 + 1, 2**42 + 2**21],
        [5, 2**42, 2**52, 2**52 + 2],
        [7] * 50 + [8] * 50,
        [random.Random(1).randrange(10**11) for _ in range(501)],
        [random.Random(2).randrange(10**7) for _ in range(1000)],
    ],
    ids=lambda v: f"{len(v)} from {v[0]}",
)
def test_median(spark, values):
    row = total_and_median(counts_frame(spark, values), "v", "n").first()
    assert (int(row.total), row.n) == (sum(values), len(values))
    assert row.median == statistics.median(values)


def test_median_of_nothing(spark):
    row = total_and_median(counts_frame(spark, [1]).limit(0), "v", "n").first()
    assert tuple(row) == (None, None, None)


def test_rates(spark):
    row = spark.range(1).select(
        pct(F.lit(1), F.lit(32)).alias("tie"),
        pct(F.lit(1), F.lit(0)).alias("none"),
        money_per(F.lit("10.00").cast("decimal(20,2)"), F.lit(3)).alias("aov"),
        money_per(F.lit("0.05").cast("decimal(20,2)"), F.lit(2)).alias("half_cent"),
        money_per(F.lit("1.00").cast("decimal(20,2)"), F.lit(0)).alias("no_orders"),
    ).first()
    assert tuple(row) == (3.13, None, 3.33, 0.03, None)


def test_mean_of_rounded_skips_nulls(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    assert df.agg(mean_of_rounded("x")).first()[0] == 0.15
    assert df.limit(0).agg(mean_of_rounded("x")).first()[0] is None
