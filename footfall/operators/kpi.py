"""Daily business metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import day
from footfall.functions.rates import money_per, pct
from footfall.operators.sessions import session_groups
from footfall.schema import PURCHASE, is_event
from footfall.sources.events import on_days


def purchase_rows() -> Column:
    return F.count(F.when(is_event(PURCHASE), 1))


def purchase_amount() -> Column:
    return F.sum(F.when(is_event(PURCHASE), F.col("price")))


def _money(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0)).cast("decimal(30,2)")


def _per_user_day(events: DataFrame) -> DataFrame:
    return events.groupBy(day("event_time").alias("event_date"), "user_id").agg(
        purchase_rows().alias("orders"), purchase_amount().alias("revenue")
    )


def kpi_daily(events: DataFrame, days: tuple[date, date] | None = None) -> DataFrame:
    """One row per day: users, sessions, buyers, orders, revenue and their ratios.

    ``events`` may be raw or sessionized. An order is a purchase row. A session over
    midnight counts on both days. ``days``, the first and last day wanted, prunes the month
    folders of the events, which a filter of the result does not.

    Users and sessions are counted on two branches that meet as partial sums per day.
    The user branch needs no session id; on sessionized events Catalyst drops the join.
    """
    of_users = (
        _per_user_day(on_days(events, days))
        .groupBy("event_date")
        .agg(
            F.count("user_id").alias("dau"),
            F.count(F.when(F.col("orders") > 0, F.col("user_id"))).alias("purchasing_users"),
            F.sum("orders").alias("total_orders"),
            F.sum("revenue").alias("total_revenue"),
        )
    )
    of_sessions = (
        session_groups(events, {"event_date": day("event_time")}, {}, days=days)
        .select("event_date", "effective_session_id")
        .distinct()
        .groupBy("event_date")
        .agg(F.count("effective_session_id").alias("total_sessions"))
    )
    daily = (
        of_users.unionByName(of_sessions, allowMissingColumns=True)
        .groupBy("event_date")
        .agg(
            F.sum("dau").alias("dau"),
            F.sum("total_sessions").alias("total_sessions"),
            F.sum("purchasing_users").alias("purchasing_users"),
            F.sum("total_orders").alias("total_orders"),
            _money(F.sum("total_revenue")).alias("total_revenue"),
        )
    )
    return daily.select(
        "*",
        money_per("total_revenue", "total_orders").alias("aov"),
        money_per("total_revenue", "dau").alias("arpu"),
        pct("purchasing_users", "dau").alias("daily_conversion_rate_pct"),
    )


def kpi_trends(events: DataFrame) -> DataFrame:
    """Daily trend lines: active users, revenue, orders and the unrounded order value."""
    daily = _per_user_day(events).groupBy("event_date").agg(
        F.count("user_id").alias("dau"),
        _money(F.sum("revenue")).alias("revenue"),
        F.sum("orders").alias("orders"),
    )
    aov = F.col("revenue").cast("double") / F.nullif(F.col("orders"), F.lit(0))
    return daily.withColumn("aov", aov).orderBy("event_date")
