"""Ratios, money and averages that give the same digits whatever the row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(part: Column | str, whole: Column | str, scale: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is 0.

    The multiplication comes before the division so that ties such as 1/32 round
    half up as the exact decimal would.
    """
    return F.round(F.lit(100.0) * _col(part) / F.nullif(_col(whole), F.lit(0)), scale)


def step_rates(
    view: str, cart: str, purchase: str, overall_cr: str, overall_dropoff: str
) -> list[Column]:
    """Conversion and drop-off percentages of a three-step funnel, pair by pair.

    The first three arguments name the step counts, the last two the overall rates.
    """
    pairs = [
        (view, cart, "cr_view_to_cart_pct", "dropoff_view_to_cart_pct"),
        (cart, purchase, "cr_cart_to_purchase_pct", "dropoff_cart_to_purchase_pct"),
        (view, purchase, overall_cr, overall_dropoff),
    ]
    return [
        rate
        for start, end, conversion, dropoff in pairs
        for rate in (
            pct(end, start).alias(conversion),
            pct(F.col(start) - F.col(end), start).alias(dropoff),
        )
    ]


def money_per(amount: Column | str, count: Column | str) -> Column:
    """A DECIMAL amount divided by a count, to whole cents, half up; NULL when count is 0.

    Works on integer cents, so the quotient is rounded once.
    """
    cents = (_col(amount) * 100).cast("double")
    return F.round(cents / F.nullif(_col(count), F.lit(0)), 0) / 100


def mean_of_rounded(c: Column | str) -> Column:
    """Mean of values already rounded to two places, skipping NULLs.

    Summed as DECIMAL: a DOUBLE sum would depend on the order of the partitions.
    """
    return F.sum(_col(c).cast("decimal(18,2)")).cast("double") / F.nullif(
        F.count(_col(c)), F.lit(0)
    )
