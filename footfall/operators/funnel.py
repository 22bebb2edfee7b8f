"""Conversion funnels. Three of them, with different rules, kept apart:

session_funnel / funnel_overall   ordered, within a session
funnel_summary                    unordered, within a day, category, brand and session
funnel_users                      unordered, over all time, per user
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import day, epoch_us
from footfall.functions.distinct import by_user_and_session, of_known_user, of_session, of_user
from footfall.functions.median import total_and_median, totals_and_medians
from footfall.functions.rates import step_rates
from footfall.operators.sessions import per_session
from footfall.schema import CART, NO_BRAND, NO_CATEGORY, PURCHASE, VIEW, is_event

MICROS = 1_000_000


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _split_rates(*names: str) -> tuple[list[Column], list[Column]]:
    """Step rates as (conversion, drop-off) columns."""
    rates = step_rates(*names)
    return rates[0::2], rates[1::2]


# --- ordered, within a session ----------------------------------------------------


def session_funnel(steps: DataFrame) -> DataFrame:
    """Steps reached by each session, in order of their first occurrence.

    Time to buy runs from the first view to the first purchase; it needs no cart.
    """
    view, cart, purchase = (
        F.col(c) for c in ("min_view_time", "min_cart_time", "min_purchase_time")
    )
    in_cart = cart >= view
    return steps.select(
        "user_id",
        "effective_session_id",
        view,
        cart,
        purchase,
        flag(view.isNotNull()).alias("reached_view"),
        flag(in_cart).alias("reached_cart"),
        flag(in_cart & (purchase >= cart)).alias("reached_purchase"),
        (_ttb_micros() / MICROS).alias("ttb_seconds"),
    )


def _ttb_micros() -> Column:
    view, purchase = F.col("min_view_time"), F.col("min_purchase_time")
    return F.when(purchase >= view, epoch_us(purchase) - epoch_us(view))


_REACHED = {
    "reached_view": "step_1_view",
    "reached_cart": "step_2_cart",
    "reached_purchase": "step_3_purchase",
}


def _time_to_buy(steps: DataFrame) -> DataFrame:
    """One row: total, count and median of the sessions' time to buy, in microseconds.

    ``reached_cart`` is part of the grouping only to keep all three step times in the
    session aggregate: Spark then reuses the shuffle that the step counts read.
    """
    counts = (
        session_funnel(steps)
        .select(_ttb_micros().alias("ttb"), "reached_cart")
        .filter(F.col("ttb").isNotNull())
        .groupBy("ttb", "reached_cart")
        .agg(F.count("*").alias("sessions"))
    )
    return total_and_median(counts, "ttb", "sessions")


def _with_ttb(counted: DataFrame, steps: DataFrame) -> DataFrame:
    """Put the one row of step counts and the one row of times side by side."""
    both = counted.unionByName(_time_to_buy(steps), allowMissingColumns=True)
    mean = F.col("total").cast("double") / F.col("n") / MICROS
    median = F.col("median") / MICROS
    return (
        both.agg(*(F.max(c).alias(c) for c in both.columns))
        .withColumn("avg_ttb_seconds", F.round(mean, 2))
        .withColumn("avg_ttb_minutes", F.round(mean / 60, 2))
        .withColumn("median_ttb_seconds", median)
        .withColumn("median_ttb_minutes", F.round(median / 60, 2))
        .drop("total", "n", "median")
    )


def funnel_step_counts(steps: DataFrame) -> DataFrame:
    """One row: distinct users and distinct sessions per step, and time to buy.

    A session id shared by two users counts as one session.
    """
    reached = by_user_and_session(
        session_funnel(steps), [], {r: F.max(r) for r in _REACHED}
    )
    counted = reached.agg(
        *(
            F.sum(F.when(of_user(), F.col(r))).alias(f"{step}_users")
            for r, step in _REACHED.items()
        ),
        *(
            F.sum(F.when(of_session(), F.col(r))).alias(f"{step}_sessions")
            for r, step in _REACHED.items()
        ),
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in counted.columns}
    return _with_ttb(counted.withColumns(zero), steps)


def funnel_overall(steps: DataFrame) -> DataFrame:
    """One row: users per step, conversion and drop-off rates, time to buy in minutes."""
    per_user = session_funnel(steps).groupBy("user_id").agg(*(F.max(r).alias(r) for r in _REACHED))
    counted = per_user.agg(
        *(
            F.coalesce(F.sum(of_known_user(r)), F.lit(0)).cast("long").alias(f"{step}_users")
            for r, step in _REACHED.items()
        )
    )
    users = [f"{step}_users" for step in _REACHED.values()]
    conversion, dropoff = _split_rates(
        *users, "overall_conversion_rate_pct", "overall_dropoff_rate_pct"
    )
    return _with_ttb(counted, steps).select(
        *users, *conversion, *dropoff, "avg_ttb_minutes", "median_ttb_minutes"
    )


# --- unordered, by day, category and brand ----------------------------------------


def top_category(code: str = "category_code") -> Column:
    """Text before the first dot; 'uncategorized' for NULL only."""
    return F.coalesce(F.split_part(F.col(code), F.lit("."), F.lit(1)), F.lit(NO_CATEGORY))


def brand_or_unknown() -> Column:
    return F.coalesce("brand", F.lit(NO_BRAND))


def funnel_summary(events: DataFrame, days: tuple[date, date] | None = None) -> DataFrame:
    """Users and sessions per step for every day, top category and brand.

    ``events`` may be raw or sessionized. ``days``, the first and last day wanted, is
    better than a filter of the result: it prunes the month folders of the events.
    A step counts only together with the earlier ones inside one (day, category, brand,
    user, session), in any order.
    """
    by = {
        "event_date": day("event_time"),
        "top_category": top_category(),
        "brand": brand_or_unknown(),
    }
    keys = list(by)
    seen = per_session(
        events,
        by,
        {f"has_{t}": (F.max, flag(is_event(t))) for t in (VIEW, CART, PURCHASE)},
        days=days,
    )
    together = seen.select(
        *keys,
        "user_id",
        "effective_session_id",
        F.col("has_view").alias("view"),
        (F.col("has_view") * F.col("has_cart")).alias("cart"),
        (F.col("has_view") * F.col("has_cart") * F.col("has_purchase")).alias("purchase"),
    )
    steps = ("view", "cart", "purchase")
    counted = (
        by_user_and_session(together, keys, {s: F.max(s) for s in steps})
        .groupBy(*keys)
        .agg(
            *(
                F.coalesce(F.sum(F.when(which(), F.col(s))), F.lit(0)).alias(f"{s}_{noun}")
                for noun, which in (("users", of_user), ("sessions", of_session))
                for s in steps
            ),
        )
    )
    rates = step_rates(
        "view_users", "cart_users", "purchase_users", "overall_cr_pct", "overall_dropoff_pct"
    )
    return counted.select("*", *rates)


CELL_KEYS = ("event_date", "top_category", "brand")


def time_to_buy(
    events: DataFrame, by: list[str], days: tuple[date, date] | None = None
) -> DataFrame:
    """Sessions that bought, with mean and median time to buy, for each combination of ``by``.

    ``by`` names some of ``event_date``, ``top_category`` and ``brand``. A session is taken
    apart by them: inside one combination its time runs from the first view to the first
    purchase, where that is not earlier. ``events`` may be raw or sessionized.
    """
    unknown = set(by) - set(CELL_KEYS)
    if unknown or not by:
        raise ValueError(f"time to buy goes by some of {', '.join(CELL_KEYS)}")
    cells = {
        "event_date": day("event_time"),
        "top_category": top_category(),
        "brand": brand_or_unknown(),
    }
    time = F.col("event_time")
    steps = per_session(
        events.filter(F.col("event_type").isin(VIEW, PURCHASE))
        if "effective_session_id" in events.columns
        else events,
        {k: cells[k] for k in by},
        {
            "min_view_time": (F.min, F.when(is_event(VIEW), time)),
            "min_purchase_time": (F.min, F.when(is_event(PURCHASE), time)),
        },
        days=days,
    )
    counts = (
        steps.select(*by, _ttb_micros().alias("ttb"))
        .filter(F.col("ttb").isNotNull())
        .groupBy(*by, "ttb")
        .agg(F.count("*").alias("sessions"))
    )
    mean = F.col("total").cast("double") / F.col("n") / MICROS
    return totals_and_medians(counts, list(by), "ttb", "sessions").select(
        *by,
        F.col("n").alias("buying_sessions"),
        F.round(mean, 2).alias("avg_ttb_seconds"),
        (F.col("median") / MICROS).alias("median_ttb_seconds"),
    )


# --- unordered, all time ----------------------------------------------------------


def funnel_users(events: DataFrame) -> DataFrame:
    """One row: distinct users with any view, any cart and any purchase."""
    steps = (VIEW, CART, PURCHASE)
    per_user = (
        events.filter(F.col("event_type").isin(*steps))
        .groupBy("user_id")
        .agg(*(F.max(flag(is_event(t))).alias(t) for t in steps))
    )
    return per_user.agg(
        *(
            F.coalesce(F.sum(of_known_user(t)), F.lit(0)).cast("long").alias(f"{t}_users")
            for t in steps
        )
    )


def funnel_users_rates(users: DataFrame) -> DataFrame:
    """The all-time funnel with conversion and drop-off rates."""
    conversion, dropoff = _split_rates(
        "view_users", "cart_users", "purchase_users", "overall_cr_pct", "overall_dropoff_pct"
    )
    return users.select("*", *conversion, *dropoff)
