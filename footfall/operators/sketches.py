"""Funnel steps over any roll-up of day, category and brand, from theta sketches.

A cell keeps, for views, carts and purchases, a sketch of its users and one of its sessions.
Sketches of any cells unite into those of their roll-up, and the intersection of a
roll-up's sketches tells who took several steps in it. No event is read again, and a
sketch never exceeds 8 bytes times its nominal entries, however many users it stands for.

Counts are exact up to ``2 ** LG_ENTRIES`` users or sessions. Beyond, the relative standard error
of a set is 1 / sqrt(2 ** LG_ENTRIES), 0.8 %; that of an intersection is larger by the
square root of (size of the union / size of the intersection).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import day
from footfall.functions.rates import step_rates
from footfall.operators.funnel import brand_or_unknown, top_category
from footfall.operators.sessions import session_groups
from footfall.schema import CART, PURCHASE, VIEW, is_event

LG_ENTRIES = 14
CELL = ["event_date", "top_category", "brand"]
STEPS = (VIEW, CART, PURCHASE)
NOUNS = {"users": "user_id", "sessions": "effective_session_id"}


def funnel_sketches(events: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """One row per day, top category and brand: ``view_users_sketch`` and five like it.

    ``events`` may be raw or sessionized. A cell without an event of a type has empty sketches.
    """
    keys = {
        "event_date": day("event_time"),
        "top_category": top_category(),
        "brand": brand_or_unknown(),
    }
    seen = session_groups(
        events, keys, {t: (F.max, F.when(is_event(t), 1)) for t in STEPS}
    )
    sketches = (
        F.theta_sketch_agg(F.when(F.col(t) == 1, F.col(c)), lg_entries).alias(f"{t}_{noun}_sketch")
        for noun, c in NOUNS.items()
        for t in STEPS
    )
    return seen.groupBy(*CELL).agg(*sketches)


def funnel_rollup(
    sketches: DataFrame, by: list[str], lg_entries: int = LG_ENTRIES
) -> DataFrame:
    """The unordered funnel of every combination of ``by``, columns of the sketches.

    Who counts for a step has taken it and the earlier ones somewhere in the roll-up,
    not necessarily on one day or in one session.
    """
    names = [f"{t}_{noun}_sketch" for noun in NOUNS for t in STEPS]
    united = sketches.groupBy(*by).agg(
        *(F.theta_union_agg(n, lg_entries).alias(n) for n in names)
    )
    counts = []
    for noun in NOUNS:
        reached = None
        for t in STEPS:
            own = F.col(f"{t}_{noun}_sketch")
            reached = own if reached is None else F.theta_intersection(reached, own)
            counts.append(F.theta_sketch_estimate(reached).alias(f"{t}_{noun}"))
    rates = step_rates(
        "view_users", "cart_users", "purchase_users", "overall_cr_pct", "overall_dropoff_pct"
    )
    return united.select(*by, *counts).select("*", *rates)


def by_levels(sketches: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """The funnel of each month, of its categories and of their brands; ``level`` 3, 1, 0.

    Each level unites the sketches of the one below it, not the cells again.
    """
    names = [f"{t}_{noun}_sketch" for noun in NOUNS for t in STEPS]
    month = F.date_format("event_date", "yyyy-MM").alias("month")
    levels, keys, below = [], ["month", "top_category", "brand"], sketches.withColumn("month", month)
    for level in (0, 1, 3):
        below = below.groupBy(*keys).agg(*(F.theta_union_agg(n, lg_entries).alias(n) for n in names))
        levels.append(
            funnel_rollup(below, keys, lg_entries).withColumn("level", F.lit(level))
        )
        keys = keys[:-1]
    first, *others = levels
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
