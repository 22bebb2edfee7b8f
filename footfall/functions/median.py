"""Exact means and medians of large groups without gathering one in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Non-negative 64-bit values are read in three digits of this many bits, so a ranking of
# one digit sees at most 2,097,152 rows, whatever the rows and the span of the values.
DIGIT_BITS = 21


def total_and_median(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: ``total`` (DECIMAL), ``n`` and the interpolated ``median`` (DOUBLE).

    ``counts`` holds non-negative integers with the number of times each occurs; a value
    may be listed more than once. Without any value all three are NULL.

    The built-in exact percentile keeps every distinct value of a group in one task.
    Here a histogram of the highest digit finds the one or two slots with the middle ranks,
    the next digit is counted inside those only, and the lowest digit gives the values.
    All three read the same aggregate, which Spark shuffles once.
    """
    counts = counts.select(F.col(value).alias("value"), F.col(weight).alias("weight"))
    top, *lower = (2 * DIGIT_BITS, DIGIT_BITS, 0)
    histogram = counts.groupBy(_slot(top)).agg(
        F.sum("weight").alias("slot_n"),
        F.sum(F.col("value").cast("decimal(20,0)") * F.col("weight")).alias("slot_total"),
    )
    everywhere = Window.orderBy("slot").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    ranked = histogram.select(
        "slot",
        "slot_n",
        F.sum("slot_n").over(everywhere).alias("n"),
        F.sum("slot_total").over(everywhere).cast("decimal(38,0)").alias("total"),
    ).select(
        "*", F.shiftright(F.col("n") - 1, 1).alias("low"), F.shiftright("n", 1).alias("high")
    )
    middle = _middle_slots(ranked, Window.orderBy("slot"))
    for shift in lower:
        # at most two rows are broadcast
        inside = counts.join(
            F.broadcast(middle), F.shiftright("value", shift + DIGIT_BITS) == F.col("parent")
        )
        histogram = inside.groupBy("parent", _slot(shift), "total", "n", "low", "high").agg(
            F.sum("weight").alias("slot_n")
        )
        middle = _middle_slots(histogram, Window.partitionBy("parent").orderBy("slot"))

    def value_at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).isNotNull(), F.col("parent")))

    return middle.agg(
        F.max("total").alias("total"),
        F.max("n").alias("n"),
        ((value_at("low") + value_at("high")) / 2.0).alias("median"),
    )


def _slot(shift: int) -> Column:
    return F.shiftright("value", shift).alias("slot")


def _middle_slots(
    histogram: DataFrame, in_order: WindowSpec, keys: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """The slots that hold the rank ``low`` or ``high``, one or two rows a group.

    The ranks count from 0 inside what ``in_order`` orders. They are returned as ranks
    inside the slot, NULL where it does not hold them; the slot is called ``parent``.
    """
    through = F.sum("slot_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = histogram.withColumn("through", through).withColumn(
        "before", F.col("through") - F.col("slot_n")
    )

    def inside(rank: str) -> Column:
        held = (F.col(rank) >= F.col("before")) & (F.col(rank) < F.col("through"))
        return F.when(held, F.col(rank) - F.col("before")).alias(rank)

    return ranked.select(
        *keys, F.col("slot").alias("parent"), "total", "n", inside("low"), inside("high")
    ).filter(F.col("low").isNotNull() | F.col("high").isNotNull())


def totals_and_medians(
    counts: DataFrame, keys: list[str], value: str, weight: str
) -> DataFrame:
    """One row per group: keys, ``total`` (DECIMAL), ``n`` and the interpolated ``median``.

    The grouped form of ``total_and_median``, for any number of groups and any size of each.
    Groups, NULL keys included, are ranked side by side: a digit has at most 2,097,152 rows of
    a group, whatever the group holds. A group without any value has no row.
    """
    counts = counts.select(
        *keys, F.col(value).alias("value"), F.col(weight).alias("weight")
    ).filter(F.col("value").isNotNull())
    top, *lower = (2 * DIGIT_BITS, DIGIT_BITS, 0)
    histogram = counts.groupBy(*keys, _slot(top)).agg(
        F.sum("weight").alias("slot_n"),
        F.sum(F.col("value").cast("decimal(20,0)") * F.col("weight")).alias("slot_total"),
    )
    of_group = Window.partitionBy(*keys)
    ranked = histogram.select(
        *keys,
        "slot",
        "slot_n",
        F.sum("slot_n").over(of_group).alias("n"),
        F.sum("slot_total").over(of_group).cast("decimal(38,0)").alias("total"),
    ).select(
        "*", F.shiftright(F.col("n") - 1, 1).alias("low"), F.shiftright("n", 1).alias("high")
    )
    middle = _middle_slots(ranked, Window.partitionBy(*keys).orderBy("slot"), keys)
    for shift in lower:
        # at most two slots a group; the slot is part of the key, so a hot group is spread
        slots = middle.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.shiftright("value", shift + DIGIT_BITS) == F.col("parent")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        inside = counts.join(slots, same)
        histogram = inside.groupBy(
            *keys, "parent", _slot(shift), "total", "n", "low", "high"
        ).agg(F.sum("weight").alias("slot_n"))
        in_parent = Window.partitionBy(*keys, "parent").orderBy("slot")
        middle = _middle_slots(histogram, in_parent, keys)

    def value_at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).isNotNull(), F.col("parent")))

    return middle.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.max("n").alias("n"),
        ((value_at("low") + value_at("high")) / 2.0).alias("median"),
    )
