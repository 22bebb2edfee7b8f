"""Days, weeks, months and fixed-width time slots (session time zone, UTC by contract)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: str) -> Column:
    return F.to_date(ts)


def week(ts: str) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", F.col(ts)))


def month(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "month")


def iso_week_label(week_start: Column) -> Column:
    """``2025-W01`` for 2024-12-30: ISO year with ISO week, so labels never collide."""
    return F.format_string(
        "%d-W%02d", F.extract(F.lit("YEAROFWEEK"), week_start), F.weekofyear(week_start)
    )


def months_between_firsts(later: Column, earlier: Column) -> Column:
    return (
        (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))
    ).cast("long")


def micros(width: timedelta) -> int:
    return width // timedelta(microseconds=1)


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch; a time without zone is taken in the session zone."""
    return F.unix_micros(ts.cast("timestamp"))


def slot_start(ts: Column, width_us: int) -> Column:
    """Start, in epoch microseconds, of the fixed-width slot that holds ``ts``."""
    us = epoch_us(ts)
    return us - F.pmod(us, F.lit(width_us).cast("long"))


def elapsed_days(ts: Column, since: Column) -> Column:
    """Whole 24-hour blocks from ``since`` to a later ``ts``, to the microsecond."""
    day_us = F.lit(micros(timedelta(days=1))).cast("long")
    elapsed = epoch_us(ts) - epoch_us(since)
    return ((elapsed - F.pmod(elapsed, day_us)) / day_us).cast("long")
