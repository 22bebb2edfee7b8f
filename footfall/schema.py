"""The raw event table and the steps that bring other frames to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("product_id", T.LongType(), False),
        T.StructField("category_id", T.LongType(), True),
        T.StructField("category_code", T.StringType(), True),
        T.StructField("brand", T.StringType(), True),
        T.StructField("price", T.DecimalType(10, 2), True),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("user_session", T.StringType(), True),
    ]
)

RAW_COLUMNS = RAW_EVENTS.fieldNames()
REQUIRED_COLUMNS = [f.name for f in RAW_EVENTS if not f.nullable]

# Event types, names for missing categories and brands, result labels.
VIEW, CART, PURCHASE = "view", "cart", "purchase"
NO_CATEGORY, NO_BRAND = "uncategorized", "unknown"
STAGE_LABELS = ("1. Product Views", "2. Cart Additions", "3. Completed Purchases")
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
STEP_LABELS = ("1. View Product", "2. Add to Cart", "3. Purchase")


def is_event(event_type: str) -> Column:
    return F.col("event_type") == event_type


def with_event_time(df: DataFrame) -> DataFrame:
    """Parse ``event_time`` when it arrives as text; leave other types alone."""
    if isinstance(df.schema["event_time"].dataType, T.StringType):
        return df.withColumn("event_time", F.to_timestamp("event_time"))
    return df


def require_utc(spark: SparkSession) -> None:
    """Days, weeks and months are those of the session time zone, which must be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"the session time zone must be UTC, not {zone}")


def conform(df: DataFrame, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Project a frame onto ``RAW_EVENTS``: declared order and types, then ``extra`` columns.

    A missing nullable column becomes NULL, a missing required one is an error.
    Values that do not fit their type raise (ANSI casts); use
    ``sources.validation.validate_events`` to set such rows aside instead.
    """
    present = df.columns
    missing = [c for c in REQUIRED_COLUMNS if c not in present]
    if missing:
        raise ValueError(f"raw events lack required columns: {', '.join(missing)}")
    require_utc(df.sparkSession)
    df = with_event_time(df)
    return df.select(
        *(
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RAW_EVENTS
        ),
        *extra,
    )
