"""Distinct counts of users and sessions side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER, SESSION = "_user", "_session"


def by_user_and_session(
    df: DataFrame, keys: list[str], measures: dict[str, Column]
) -> DataFrame:
    """Aggregate ``measures`` per (keys, user) and per (keys, session) in one shuffle.

    Every input row counts once for its user and once for its session. The result has
    one row per key and user (``_session`` NULL) and one per key and session (``_user``
    NULL), so counting its rows gives distinct users and sessions. Both aggregate
    map-side, and the input is read once instead of once per counted column.
    """
    grain = F.array(
        F.struct(
            F.col("user_id").alias(USER),
            F.lit(None).cast("string").alias(SESSION),
            F.lit(True).alias("of_user"),
        ),
        F.struct(
            F.lit(None).cast("long").alias(USER),
            F.col("effective_session_id").alias(SESSION),
            F.lit(False).alias("of_user"),
        ),
    )
    return (
        df.withColumn("_grain", F.explode(grain))
        .select("*", "_grain.*")
        .groupBy(*keys, USER, SESSION, "of_user")
        .agg(*(c.alias(name) for name, c in measures.items()))
    )


def of_user() -> Column:
    """Rows that stand for a known user; NULL is no user, as in COUNT(DISTINCT user_id)."""
    return F.col("of_user") & F.col(USER).isNotNull()


def of_session() -> Column:
    """Rows that stand for a known session."""
    return ~F.col("of_user") & F.col(SESSION).isNotNull()


def of_known_user(value: str) -> Column:
    """A value of a group per user, NULL for the group without one."""
    return F.when(F.col("user_id").isNotNull(), F.col(value))
