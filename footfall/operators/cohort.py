"""Cohort retention by day, week or month."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.calendar import (
    day,
    elapsed_days,
    iso_week_label,
    micros,
    month,
    months_between_firsts,
    slot_start,
    week,
)
from footfall.functions.rates import pct
from footfall.schema import is_event, with_event_time

GRANULARITIES = ("D", "W", "M")

# Width of the slots over which ``cohort_events`` spreads a user's events.
SLOT = timedelta(minutes=30)


def _granularity(value: str) -> str:
    if value.upper() not in GRANULARITIES:
        raise ValueError("granularity must be 'D' (day), 'W' (week) or 'M' (month)")
    return value.upper()


def _period_start(granularity: str, ts: str) -> Column:
    return {"D": day, "W": week, "M": month}[granularity](ts)


def _label(granularity: str, start: Column) -> Column:
    if granularity == "W":
        return iso_week_label(start)
    return F.date_format(start, "yyyy-MM" if granularity == "M" else "yyyy-MM-dd")


def _index(granularity: str, start: Column, cohort: Column) -> Column:
    if granularity == "W":
        return (F.datediff(start, cohort) / 7).cast("long")
    return months_between_firsts(start, cohort)


def _select_events(events: DataFrame, event_filter: str | None) -> DataFrame:
    """The filter comes first: cohorts start at the first event that passes it."""
    events = with_event_time(events)
    return events.filter(is_event(event_filter)) if event_filter else events


def active_periods(events: DataFrame, granularity: str) -> DataFrame:
    """Distinct (user, cohort start, cohort index).

    Events are first reduced to one row per user and day, week or month. The window
    over a user runs on that, so it is bounded by the length of the history, and the
    truncated minimum is the minimum of the truncated, which spares a join back to the
    events.
    """
    by_user = Window.partitionBy("user_id")
    events = events.filter(F.col("user_id").isNotNull())
    if granularity != "D":
        periods = events.select(
            "user_id", _period_start(granularity, "event_time").alias("start")
        ).distinct()
        return periods.withColumn("cohort", F.min("start").over(by_user)).select(
            "user_id", "cohort", _index(granularity, F.col("start"), F.col("cohort")).alias("index")
        )
    # Days count 24-hour blocks from the user's first event. The events of one calendar
    # day fall into at most two blocks, those of its first and its last event.
    days = events.groupBy("user_id", day("event_time").alias("start")).agg(
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time")
    )
    since = days.withColumn("since", F.min("first_time").over(by_user))
    blocks = F.array(
        elapsed_days(F.col("first_time"), F.col("since")),
        elapsed_days(F.col("last_time"), F.col("since")),
    )
    return since.select(
        "user_id", F.to_date("since").alias("cohort"), F.explode(blocks).alias("index")
    ).distinct()


def _retention(events: DataFrame, granularity: str) -> DataFrame:
    """Active users and cohort size per (cohort start, index).

    A user's first event has index 0, so the size is the count at index 0.
    """
    counts = (
        active_periods(events, granularity)
        .groupBy("cohort", "index")
        .agg(F.count("*").alias("active_users"))
    )
    size = F.max(F.when(F.col("index") == 0, F.col("active_users"))).over(
        Window.partitionBy("cohort")
    )
    return counts.withColumn("cohort_size", size)


def cohort_retention_weekly(sessionized: DataFrame) -> DataFrame:
    """Weekly retention mart: one row per cohort week and elapsed week."""
    return flat_retention_weekly(sessionized).orderBy("cohort_week", "cohort_index")


def flat_retention_weekly(sessionized: DataFrame) -> DataFrame:
    """The rows of ``cohort_retention_weekly`` in no order."""
    return _retention(sessionized, "W").select(
        F.col("cohort").alias("cohort_week"),
        F.concat(F.lit("Week "), F.col("index").cast("string")).alias("cohort_period_label"),
        F.col("index").alias("cohort_index"),
        "cohort_size",
        "active_users",
        pct("active_users", "cohort_size").alias("retention_rate_pct"),
    )


def cohort_retention(
    events: DataFrame,
    granularity: str = "W",
    event_filter: str | None = None,
    scale: int = 2,
) -> DataFrame:
    """Flat retention table: cohort, index, active users, cohort size, rate."""
    flat = flat_retention(events, granularity, event_filter, scale)
    return flat.orderBy("cohort_group", "cohort_index")


def flat_retention(
    events: DataFrame,
    granularity: str = "W",
    event_filter: str | None = None,
    scale: int = 2,
) -> DataFrame:
    """The rows of ``cohort_retention`` in no order, to be written or put in a matrix."""
    granularity = _granularity(granularity)
    return _retention(_select_events(events, event_filter), granularity).select(
        _label(granularity, F.col("cohort")).alias("cohort_group"),
        F.col("index").alias("cohort_index"),
        "active_users",
        "cohort_size",
        pct("active_users", "cohort_size", scale).alias("retention_rate"),
    )


def cohort_events(
    events: DataFrame, granularity: str = "W", event_filter: str | None = None
) -> DataFrame:
    """Every event with its user's first event time, cohort, own period and index.

    The first time is looked up per (user, time slot) rather than per user, so that one
    user's events do not all meet in one task.
    """
    granularity = _granularity(granularity)
    events = _select_events(events, event_filter)
    columns = events.columns
    slotted = events.withColumn("slot", slot_start(F.col("event_time"), micros(SLOT)))
    first = slotted.groupBy("user_id", "slot").agg(F.min("event_time").alias("first_event_time"))
    first = first.withColumn(
        "first_event_time", F.min("first_event_time").over(Window.partitionBy("user_id"))
    )
    start = _period_start(granularity, "event_time")
    cohort = _period_start(granularity, "first_event_time")
    index = (
        elapsed_days(F.col("event_time"), F.col("first_event_time"))
        if granularity == "D"
        else _index(granularity, start, cohort)
    )
    return slotted.join(first, ["user_id", "slot"]).select(
        *columns,
        "first_event_time",
        _label(granularity, cohort).alias("cohort_group"),
        _label(granularity, start).alias("event_period"),
        index.alias("cohort_index"),
    )


def cohort_matrix(flat: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """One row per cohort, one column per index that occurs; other cells are NULL.

    ``value`` is ``active_users`` or ``retention_rate``. The columns are part of the schema,
    so the indexes are read from ``flat`` first: write the flat table and pass what is read
    back where it is costly to compute twice.
    """
    found = sorted(r[0] for r in flat.select("cohort_index").distinct().collect())
    # one value per cell; max, unlike first, lets Catalyst drop the sort of ``flat``
    return (
        flat.groupBy("cohort_group")
        .pivot("cohort_index", found)
        .agg(F.max(value))
        .withColumnsRenamed({str(i): f"{prefix}{i}" for i in found})
        .orderBy("cohort_group")
    )


def matrix_cells(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A matrix turned back to rows: one per cell that is not NULL."""
    return matrix.unpivot(row, None, column, value).filter(F.col(value).isNotNull())
