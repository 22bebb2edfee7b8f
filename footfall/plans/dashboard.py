"""Data sets behind the dashboard charts, and its global filters.

Most read the marts and aggregate them as the charts are specified: daily distinct
users are summed and rounded daily percentages averaged, although neither adds up to
the figure over the whole period.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.distinct import of_known_user
from footfall.functions.rates import mean_of_rounded, money_per, pct
from footfall.operators.funnel import brand_or_unknown, flag, top_category
from footfall.operators.kpi import purchase_amount
from footfall.schema import PURCHASE, STEP_LABELS, VIEW, is_event


def kpi_cards(kpi_daily: DataFrame) -> DataFrame:
    """One row: revenue, mean DAU, order value over all orders, mean daily conversion."""
    totals = kpi_daily.agg(
        F.sum("total_revenue").alias("total_revenue"),
        (F.sum("dau") / F.nullif(F.count("dau"), F.lit(0))).alias("average_dau"),
        F.sum("total_orders").alias("total_orders"),
        mean_of_rounded("daily_conversion_rate_pct").alias("overall_cr_pct"),
    )
    return totals.select(
        "total_revenue",
        "average_dau",
        money_per("total_revenue", "total_orders").alias("average_order_value"),
        "overall_cr_pct",
    )


def funnel_totals(summary: DataFrame) -> DataFrame:
    """Three rows: step label, summed users, and their share of the first and last step."""
    totals = summary.agg(*(F.sum(f"{s}_users").alias(s) for s in ("view", "cart", "purchase")))
    # its users and those of the step before
    pairs = [("view", "view"), ("cart", "view"), ("purchase", "cart")]
    cells = (
        c
        for label, (users, previous) in zip(STEP_LABELS, pairs)
        for c in (F.lit(label), F.col(users), F.col(previous), F.col("view"))
    )
    steps = totals.select(
        F.stack(F.lit(len(pairs)), *cells).alias("step", "users", "previous", "first")
    )
    return steps.select(
        "step",
        "users",
        pct("users", "previous").alias("step_cr_pct"),
        pct("users", "first").alias("overall_cr_pct"),
    )


def dropoff_by_category(summary: DataFrame) -> DataFrame:
    """Mean drop-off rates per top category; days without a rate do not count."""
    rates = ("dropoff_view_to_cart_pct", "dropoff_cart_to_purchase_pct")
    return summary.groupBy("top_category").agg(
        *(mean_of_rounded(r).alias(f"avg_{r}") for r in rates)
    )


def cohort_pivot(retention: DataFrame) -> DataFrame:
    """Cohort weeks against all elapsed weeks that occur, mean retention rate per cell.

    The weeks are read from ``retention`` first, see ``cohort_matrix``.
    """
    weeks = sorted(r[0] for r in retention.select("cohort_index").distinct().collect())
    return (
        retention.groupBy("cohort_week")
        .pivot("cohort_index", weeks)
        .agg(mean_of_rounded("retention_rate_pct"))
        .withColumnsRenamed({str(i): f"week_{i}" for i in weeks})
        .orderBy("cohort_week")
    )


def _treemap_measures() -> list:
    return [
        F.sum(F.col("purchase_users") * 100).alias("volume"),
        mean_of_rounded("overall_cr_pct").alias("avg_overall_cr_pct"),
    ]


def treemap(summary: DataFrame) -> DataFrame:
    """Volume proxy and mean conversion per (top category, brand)."""
    return summary.groupBy("top_category", "brand").agg(*_treemap_measures())


def treemap_rollup(summary: DataFrame) -> DataFrame:
    """The treemap with its parent levels; ``level`` is 0 for brands, 1 and 3 above."""
    return summary.rollup("top_category", "brand").agg(
        F.grouping_id("top_category", "brand").alias("level"), *_treemap_measures()
    )


def category_revenue(events: DataFrame, summary: DataFrame) -> DataFrame:
    """Revenue of each top category with the mean conversion of its funnel rows.

    Both sides are one row per category, so they are stacked and summed, not joined.
    """
    revenue = events.groupBy(top_category().alias("top_category")).agg(
        F.coalesce(purchase_amount(), F.lit(0)).cast("decimal(30,2)").alias("revenue")
    )
    conversion = summary.groupBy("top_category").agg(
        mean_of_rounded("overall_cr_pct").alias("avg_overall_cr_pct")
    )
    return (
        revenue.unionByName(conversion, allowMissingColumns=True)
        .groupBy("top_category")
        .agg(*(F.max(c).alias(c) for c in ("revenue", "avg_overall_cr_pct")))
    )


def brand_matrix(events: DataFrame) -> DataFrame:
    """Revenue, conversion (buyers of viewers) and active users of each brand."""
    per_user = events.groupBy(brand_or_unknown().alias("brand"), "user_id").agg(
        purchase_amount().alias("revenue"),
        F.max(flag(is_event(VIEW))).alias("viewed"),
        F.max(flag(is_event(PURCHASE))).alias("bought"),
    )
    brands = per_user.groupBy("brand").agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(30,2)").alias("revenue"),
        F.sum(of_known_user("viewed")).alias("viewers"),
        F.sum(of_known_user("bought")).alias("buyers"),
        F.count("user_id").alias("active_users"),
    )
    return brands.select(
        "brand", "revenue", pct("buyers", "viewers").alias("cr_pct"), "active_users"
    )


# --- global filters ---------------------------------------------------------------


def last_days(as_of: date, days: int = 30) -> tuple[date, date]:
    """First and last of the ``days`` days ending with ``as_of``, for marts built on a range."""
    return as_of - timedelta(days=days - 1), as_of


def in_last_days(
    df: DataFrame, as_of: date, days: int = 30, column: str = "event_date"
) -> DataFrame:
    """Rows of the ``days`` days ending with ``as_of``, both ends included."""
    return in_date_range(df, *last_days(as_of, days), column)


def in_date_range(df: DataFrame, first: date, last: date, column: str = "event_date") -> DataFrame:
    return df.filter(F.col(column).between(first, last))


def among(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Multi-select: an empty selection filters nothing."""
    return df.filter(F.col(column).isin(list(values))) if values else df
