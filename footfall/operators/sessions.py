"""Sessions from inactivity gaps, and the first time of each step in a session."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.calendar import epoch_us, micros, slot_start
from footfall.schema import CART, PURCHASE, VIEW, is_event
from footfall.sources.events import on_days

GAP = timedelta(minutes=30)


def numbered_slots(
    events: DataFrame, gap: timedelta = GAP, by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """(user, slot, first_time, last_time, session_seq) of every time slot that has events.

    Slots are as wide as the gap, so two events of a user in one slot are always
    closer than the gap: a slot never spans a session boundary, and only its first
    and last event time matter. The raw rows are therefore reduced by a plain
    aggregation, and the window sees at most one row per user and slot - a user with
    a third of all events has 17,520 of them a year. ``by`` names further columns that keep
    sessions apart; each of their values has a numbering of its own.
    """
    width = micros(gap)
    if width <= 0:
        raise ValueError("the inactivity gap must be positive")
    slots = events.groupBy(
        "user_id", *by, slot_start(F.col("event_time"), width).alias("slot")
    ).agg(F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
    in_order = Window.partitionBy("user_id", *by).orderBy("slot")
    previous = F.lag("last_time").over(in_order)
    starts = previous.isNull() | (
        epoch_us(F.col("first_time")) - epoch_us(previous) > F.lit(width)
    )
    through = F.sum("starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return slots.withColumn("starts", F.when(starts, 1).otherwise(0)).select(
        "user_id", *by, "slot", "first_time", "last_time", through.alias("session_seq")
    )


def session_slots(events: DataFrame, gap: timedelta = GAP) -> DataFrame:
    """Session number of every (user, time slot) that has events."""
    return numbered_slots(events, gap).select("user_id", "slot", "session_seq")


def calculated_id(number: Column) -> Column:
    return F.concat(F.col("user_id").cast("string"), F.lit("_s"), number.cast("string"))


def _calculated_id() -> Column:
    return calculated_id(F.col("session_seq"))


def sessionize(events: DataFrame, gap: timedelta = GAP) -> DataFrame:
    """Every event with its calculated and its effective session id.

    A session ends when more than ``gap`` passes without an event of the user; exactly
    ``gap`` stays inside. The effective id is the frontend's own id where there is one.
    Rows in = rows out. Filter by time afterwards, never before: sessions depend on a
    user's whole history.

    Rows look up their session by an equi-join on (user, slot), which spreads one user's
    rows over many partitions. It is a left join on unique keys, so a result without
    session ids loses it in optimization.
    """
    return (
        events.withColumn("slot", slot_start(F.col("event_time"), micros(gap)))
        .join(session_slots(events, gap), ["user_id", "slot"], "left")
        .select(
            "event_time",
            "event_type",
            "product_id",
            "category_id",
            "category_code",
            "brand",
            "price",
            "user_id",
            F.col("user_session").alias("raw_user_session"),
            _calculated_id().alias("calculated_session_id"),
            F.coalesce("user_session", _calculated_id()).alias("effective_session_id"),
        )
    )


Measure = tuple[Callable[[Column], Column], Column]


def _aggregate(frame: DataFrame, by: list, measures: dict[str, Measure]) -> DataFrame:
    if not measures:
        return frame.select(*by).distinct()
    return frame.groupBy(*by).agg(*(f(c).alias(n) for n, (f, c) in measures.items()))


def session_groups(
    df: DataFrame,
    keys: dict[str, Column],
    measures: dict[str, Measure],
    gap: timedelta = GAP,
    days: tuple[date, date] | None = None,
) -> DataFrame:
    """``user_id``, ``effective_session_id``, keys and partial measures, any number of rows each.

    ``measures`` maps a name to (function, input), the function being one that merges its
    own results: ``F.min``, ``F.max`` or ``F.sum``. ``df`` is either sessionized already,
    or raw events. Of those, rows with a frontend session need no lookup; the others are
    first aggregated per (user, slot, keys), so that groups rather than rows are looked up
    and a hot group shrinks before any shuffle.

    ``days`` keeps the events from the first to the last of two days. Sessions are still
    numbered over the whole history, so ids do not depend on the range.
    """
    wanted = on_days(df, days)
    key_columns = [c.alias(n) for n, c in keys.items()]
    inputs = [c.alias(n) for n, (_, c) in measures.items()]
    if "effective_session_id" in df.columns:
        return wanted.select("user_id", "effective_session_id", *key_columns, *inputs)
    session = F.col("user_session")
    named = wanted.filter(session.isNotNull()).select(
        "user_id", session.alias("effective_session_id"), *key_columns, *inputs
    )
    slot = slot_start(F.col("event_time"), micros(gap)).alias("slot")
    unnamed = _aggregate(
        wanted.filter(session.isNull()), ["user_id", slot, *key_columns], measures
    ).join(session_slots(df, gap), ["user_id", "slot"], "left")
    return named.unionByName(
        unnamed.select(
            "user_id", _calculated_id().alias("effective_session_id"), *keys, *measures
        )
    )


def per_session(
    df: DataFrame,
    keys: dict[str, Column],
    measures: dict[str, Measure],
    gap: timedelta = GAP,
    days: tuple[date, date] | None = None,
) -> DataFrame:
    """Aggregate raw or sessionized events per (user, effective session, keys)."""
    groups = session_groups(df, keys, measures, gap, days)
    merge = {n: (f, F.col(n)) for n, (f, _) in measures.items()}
    return _aggregate(groups, ["user_id", "effective_session_id", *keys], merge)


def step_times() -> dict[str, Measure]:
    """First time of each step, first and last time at all."""
    time = F.col("event_time")

    def first(event_type: str) -> Measure:
        return F.min, F.when(is_event(event_type), time)

    return {
        "min_view_time": first(VIEW),
        "min_cart_time": first(CART),
        "min_purchase_time": first(PURCHASE),
        "session_start_time": (F.min, time),
        "session_end_time": (F.max, time),
    }


def session_steps(df: DataFrame, per_instant: bool = False, gap: timedelta = GAP) -> DataFrame:
    """First view, cart and purchase plus first and last event of every session.

    ``df`` holds raw or sessionized events. ``per_instant`` also groups by the event time,
    one row per (user, session, instant).
    """
    keys = {"event_time": F.col("event_time")} if per_instant else {}
    steps = per_session(df, keys, step_times(), gap)
    return steps.drop("event_time")


def session_summary(
    events: DataFrame, gaps: dict[str, timedelta] | None = None, gap: timedelta = GAP
) -> DataFrame:
    """One row per user and session: first and last time, events by type and revenue.

    ``gaps`` names event types after which a user may pause longer or shorter than ``gap``; a
    session ends when no event of it reaches as far as the next one. Exactly the gap stays
    inside. Rows without a user are left out.

    Events of one slot as wide as the shortest gap always belong together, so they are added
    up to one row per user and slot first, which reaches to the furthest of their ends. Spark's
    session windows then merge these rows, with the reach of each as its gap.
    """
    gaps = gaps or {}
    shortest = min([gap, *gaps.values()])
    if shortest <= timedelta(0):
        raise ValueError("inactivity gaps must be positive")
    pause = F.lit(micros(gap))
    for event_type, own in gaps.items():
        pause = F.when(is_event(event_type), micros(own)).otherwise(pause)
    at = epoch_us(F.col("event_time"))
    counted = {f"{t}_events": F.count_if(is_event(t)) for t in (VIEW, CART, PURCHASE)}
    slots = (
        events.filter("user_id IS NOT NULL")
        .groupBy("user_id", slot_start(F.col("event_time"), micros(shortest)).alias("slot"))
        .agg(
            F.min("event_time").alias("first_time"),
            F.max("event_time").alias("last_time"),
            F.max(at + pause).alias("reach"),
            F.count("*").alias("events"),
            *(c.alias(n) for n, c in counted.items()),
            F.sum(F.when(is_event(PURCHASE), F.col("price"))).alias("revenue"),
        )
    )
    # a window that begins where another ends is merged with it
    length = (F.col("reach") - epoch_us(F.col("first_time"))).cast("decimal(18,0)") / 1_000_000
    seconds = length.cast("decimal(18,6)")
    window = F.session_window("first_time", F.make_interval(secs=seconds))
    sums = ("events", *counted)
    return (
        slots.groupBy("user_id", window.alias("session"))
        .agg(
            F.min("first_time").alias("session_start_time"),
            F.max("last_time").alias("session_end_time"),
            *(F.sum(n).alias(n) for n in sums),
            F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(30,2)").alias("revenue"),
        )
        .drop("session")
    )
