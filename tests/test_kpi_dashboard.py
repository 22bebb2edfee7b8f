from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footfall.operators.cohort import cohort_retention_weekly
from footfall.operators.funnel import funnel_summary, funnel_users
from footfall.operators.kpi import kpi_daily, kpi_trends
from footfall.operators.sessions import sessionize
from footfall.plans import charts, dashboard, marts
from footfall.settings import fresh_dir

BOTH = pytest.mark.parametrize("source", [lambda df: df, sessionize], ids=["raw", "sessionized"])


@BOTH
def test_day_without_purchase(make_events, source):
    row = kpi_daily(source(make_events(dict(event_time="2024-01-01", price=5)))).first()
    assert (row.total_orders, row.total_revenue, row.aov) == (0, Decimal("0.00"), None)
    assert (row.arpu, row.daily_conversion_rate_pct) == (0.0, 0.0)


@BOTH
def test_session_over_midnight_counts_on_both_days(make_events, source):
    df = make_events(dict(event_time="2024-01-01 23:55"), dict(event_time="2024-01-02 00:05"))
    assert [(r.dau, r.total_sessions) for r in kpi_daily(source(df)).collect()] == [(1, 1), (1, 1)]


@BOTH
def test_money_and_buyers(make_events, source):
    rows = [
        dict(event_time="2024-01-01 10:00", event_type="purchase", price="10.01", user_id=1),
        dict(event_time="2024-01-01 10:01", event_type="purchase", price="0.02", user_id=1),
        dict(event_time="2024-01-01 10:01", event_type="purchase", user_id=2),
        dict(event_time="2024-01-01 10:01", price="99", user_id=3),
    ]
    row = kpi_daily(source(make_events(*rows))).first()
    assert (row.dau, row.total_sessions, row.purchasing_users, row.total_orders) == (3, 3, 2, 3)
    assert (row.total_revenue, row.aov, row.arpu) == (Decimal("10.03"), 3.34, 3.34)
    assert row.daily_conversion_rate_pct == 66.67


def test_trends(make_events):
    rows = [
        dict(event_time="2024-01-02", event_type="purchase", price="10"),
        dict(event_time="2024-01-02", event_type="purchase", price="0.01"),
        dict(event_time="2024-01-02", event_type="purchase", price="0.01", user_id=2),
        dict(event_time="2024-01-01"),
    ]
    first, second = kpi_trends(make_events(*rows)).collect()
    assert tuple(first) == (date(2024, 1, 1), 1, Decimal("0.00"), 0, None)
    assert tuple(second)[:4] == (date(2024, 1, 2), 2, Decimal("10.02"), 3)
    assert second.aov == pytest.approx(3.34)


SUMMARY_ROWS = [
    dict(event_time=f"2024-01-0{d}", user_id=u, category_code="a.x", brand="b", event_type=t)
    for d, u, t in [(1, 1, "view"), (1, 1, "cart"), (1, 2, "view"), (2, 1, "view")]
]


def test_cards_average_the_rounded_daily_rates(make_events):
    rows = [
        dict(event_time="2024-01-01", event_type="purchase", price="3", user_id=1),
        *(dict(event_time="2024-01-01", user_id=u) for u in (2, 3)),
        dict(event_time="2024-01-02", user_id=1),
    ]
    row = dashboard.kpi_cards(kpi_daily(make_events(*rows))).first()
    assert tuple(row) == (Decimal("3.00"), 2.0, 3.0, 16.665)


def test_funnel_totals_sum_daily_users(make_events):
    rows = dashboard.funnel_totals(funnel_summary(make_events(*SUMMARY_ROWS))).collect()
    assert [tuple(r) for r in rows] == [
        ("1. View Product", 3, 100.0, 100.0),
        ("2. Add to Cart", 1, 33.33, 33.33),
        ("3. Purchase", 0, 0.0, 0.0),
    ]


def test_dropoff_skips_days_without_a_rate(make_events):
    row = dashboard.dropoff_by_category(funnel_summary(make_events(*SUMMARY_ROWS))).first()
    assert tuple(row) == ("a", 75.0, 100.0)


def test_treemap_levels(make_events):
    summary = funnel_summary(make_events(*SUMMARY_ROWS))
    rows = dashboard.treemap_rollup(summary).collect()
    levels = {r.level: (r.top_category, r.brand, r.volume) for r in rows}
    assert levels == {0: ("a", "b", 0), 1: ("a", None, 0), 3: (None, None, 0)}
    assert dashboard.treemap(summary).count() == 1


def test_brand_and_category_revenue(make_events):
    rows = [
        *SUMMARY_ROWS,
        dict(
            event_time="2024-01-05", user_id=3, category_code="a.x", brand="b",
            event_type="purchase", price="7",
        ),
    ]
    events = make_events(*rows)
    row = dashboard.brand_matrix(events).first()
    assert tuple(row) == ("b", Decimal("7.00"), 50.0, 3)
    row = dashboard.category_revenue(events, funnel_summary(events)).first()
    assert tuple(row) == ("a", Decimal("7.00"), 0.0)


def test_filters(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, d), c) for d, c in ((1, "a"), (2, "b"), (30, "a"), (31, "c"))],
        "event_date date, top_category string",
    )
    days = lambda frame: [r.event_date.day for r in frame.orderBy("event_date").collect()]
    assert days(dashboard.in_last_days(df, date(2024, 1, 31))) == [2, 30, 31]
    assert days(dashboard.in_date_range(df, date(2024, 1, 1), date(2024, 1, 2))) == [1, 2]
    assert days(dashboard.among(df, "top_category", ["a", "c"])) == [1, 30, 31]
    assert days(dashboard.among(df, "top_category", [])) == [1, 2, 30, 31]
    assert days(dashboard.among(df, "top_category", ["a' OR '1'='1"])) == []


def test_cohort_pivot_has_all_weeks(make_events):
    events = make_events(dict(event_time="2024-01-01"), dict(event_time="2024-04-15"))
    pivot = dashboard.cohort_pivot(cohort_retention_weekly(events))
    assert pivot.columns == ["cohort_week", "week_0", "week_15"]
    assert tuple(pivot.first())[1:] == (100.0, 100.0)


def test_rows_without_user_or_session_count_nowhere(make_events):
    events = make_events(
        dict(event_time="2024-01-01", user_id=0, event_type="purchase", price=2),
        dict(event_time="2024-01-01", user_id=0),
        dict(event_time="2024-01-01", user_id=7),
    ).withColumn("user_id", F.nullif("user_id", F.lit(0)))
    day = kpi_daily(events).first()
    assert (day.dau, day.total_sessions, day.purchasing_users, day.total_orders) == (1, 1, 0, 1)
    assert tuple(funnel_users(events).first()) == (1, 0, 0)
    assert dashboard.brand_matrix(events).first().active_users == 1


def test_stages(make_events):
    rows = charts.funnel_stages(funnel_users(make_events(*SUMMARY_ROWS))).collect()
    assert [tuple(r) for r in rows] == [
        ("1. Product Views", 2), ("2. Cart Additions", 1), ("3. Completed Purchases", 0),
    ]


def test_views_and_tables_hold_the_same_marts(spark, make_events):
    events = make_events(*SUMMARY_ROWS)
    marts.create_views(events)
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    marts.publish_raw(spark, events, "shop.raw_events")
    marts.publish_tables(spark, spark.table("shop.raw_events"), "shop")
    for name in [marts.SESSIONIZED, *marts.MARTS]:
        view, table = spark.table(name), spark.table(f"shop.{name}")
        assert sorted(map(str, view.collect())) == sorted(
            map(str, table.select(*view.columns).collect())
        ), name
        described = spark.sql(f"DESCRIBE EXTENDED shop.{name}").collect()
        assert any(r.col_name == "Comment" and r.data_type for r in described), name
    comments = {r.col_name: r.comment for r in spark.sql("DESCRIBE shop.raw_events").collect()}
    assert comments["user_session"]
    # publishing again replaces, it does not append
    marts.publish_raw(spark, events, "shop.raw_events")
    assert spark.table("shop.raw_events").count() == len(SUMMARY_ROWS)


def test_a_failed_publication_leaves_the_old_tables(spark, make_events, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS atomic")
    events = make_events(*SUMMARY_ROWS)
    marts.publish_tables(spark, events, "atomic")

    def contents():
        return {n: sorted(map(str, spark.table(f"atomic.{n}").collect())) for n in [marts.SESSIONIZED, *marts.MARTS]}

    before, databases = contents(), {d.name for d in spark.catalog.listDatabases()}

    def fails(events):
        return events.select(F.raise_error(F.lit("half-way")).alias("x"))

    broken = {**marts.MARTS, "v_cohort_retention": (fails, "")}
    monkeypatch.setattr(marts, "MARTS", broken)
    with pytest.raises(Exception, match="half-way"):
        marts.publish_tables(spark, events.limit(1), "atomic")
    assert contents() == before
    assert {d.name for d in spark.catalog.listDatabases()} == databases
    monkeypatch.undo()
    for _ in range(3):
        marts.publish_tables(spark, events.filter("event_type = 'view'"), "atomic")
    assert contents() != before
    # the version before is kept, older ones are gone
    assert len(spark.catalog.listDatabases("atomic__marts_*")) == 2


def test_a_table_of_that_name_gives_way(spark, make_events):
    spark.sql("CREATE DATABASE IF NOT EXISTS older")
    spark.range(3).write.saveAsTable("older.v_kpi_daily")
    marts.publish_tables(spark, make_events(*SUMMARY_ROWS), "older", names=["v_kpi_daily"])
    assert "dau" in spark.table("older.v_kpi_daily").columns
    assert not spark.catalog.tableExists("older.v_funnel_summary")


def test_a_folder_shows_one_version(spark, make_events, monkeypatch):
    folder = fresh_dir(spark, "marts")
    events = make_events(*SUMMARY_ROWS)
    assert marts.publish_folder(spark, events, folder) == 1

    def fails(events):
        raise RuntimeError("half-way")

    monkeypatch.setattr(marts, "MARTS", {**marts.MARTS, "v_cohort_retention": (fails, "")})
    with pytest.raises(RuntimeError, match="half-way"):
        marts.publish_folder(spark, events.filter("event_type = 'view'"), folder)
    monkeypatch.undo()
    for name in marts.create_views(events):
        shown = marts.published(spark, folder, name)
        assert sorted(map(str, shown.select(*spark.table(name).columns).collect())) == sorted(
            map(str, spark.table(name).collect())
        )
