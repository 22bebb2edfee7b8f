"""Data sets behind the report charts and heat maps; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.cohort import cohort_matrix, flat_retention
from footfall.schema import STAGE_LABELS


def weekly_cohort_rates(events: DataFrame) -> DataFrame:
    """Flat weekly retention with rates to one decimal, in no order."""
    return flat_retention(events, "W", scale=1)


def weekly_cohort_chart(weekly_rates: DataFrame) -> DataFrame:
    """The matrix of ``weekly_cohort_rates``."""
    return cohort_matrix(weekly_rates, "retention_rate")


def funnel_stages(users: DataFrame) -> DataFrame:
    """The all-time funnel as three rows of stage label and users."""
    counts = ("view_users", "cart_users", "purchase_users")
    cells = (
        c for label, users in zip(STAGE_LABELS, counts) for c in (F.lit(label), F.col(users))
    )
    return users.select(F.stack(F.lit(len(counts)), *cells).alias("stage", "users"))


def heatmap_feed(
    flat: DataFrame, prefix: str = "Period", gap: str = " "
) -> DataFrame:
    """Every cell of the retention heat map with its row label, column label and text.

    Cells without activity are present with a NULL rate and empty text. ``gap`` is put
    between cohort and size in the row label.
    """
    cohorts = flat.groupBy("cohort_group").agg(
        F.max(F.when(F.col("cohort_index") == 0, F.col("cohort_size"))).alias("size"),
        # at most one entry per elapsed period
        F.map_from_entries(
            F.collect_list(F.struct("cohort_index", "retention_rate"))
        ).alias("rates"),
        F.max("cohort_index").alias("last"),
    )
    # one row per cohort: the last index of all of them
    cohorts = cohorts.withColumn("last", F.max("last").over(Window.partitionBy()))
    cells = cohorts.select(
        "cohort_group",
        F.coalesce("size", F.lit(0)).alias("size"),
        "rates",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias(
            "cohort_index"
        ),
    ).withColumn("retention_rate", F.try_element_at("rates", F.col("cohort_index")))
    return cells.select(
        "cohort_group",
        "cohort_index",
        F.format_string(f"%s{gap}(N=%d)", "cohort_group", "size").alias("row_label"),
        F.concat(F.lit(f"{prefix} "), F.col("cohort_index").cast("string")).alias("column_label"),
        "retention_rate",
        F.when(F.col("retention_rate").isNull(), "")
        .otherwise(F.format_string("%.1f%%", "retention_rate"))
        .alias("cell_text"),
    )
