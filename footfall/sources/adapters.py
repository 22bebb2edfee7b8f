"""Raw event frames made from the provided test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.schema import RAW_EVENTS, conform
from footfall.sources.validation import hyphenated

PART = "p_partkey long, p_name string, p_brand string, p_type string"


def shop_events(
    spark: SparkSession, sf_dir: str, products: bool = True, gaps: bool = False
) -> DataFrame:
    """The ``events`` stream as shop clicks, with product names from ``part``.

    click -> cart, error -> remove_from_cart, other types unchanged. Every user looks at
    one product a day, taken from the whole of ``part``; frontend sessions are per user and
    day, and a fifth are missing. Without ``products`` the category and brand stay NULL. With
    ``gaps`` every 13th event has no user.
    """
    # with a schema no job reads the footers while the plan is built
    part = spark.read.schema(PART).parquet(f"{sf_dir}/part.parquet")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the keys of part count up from 0
    parts = part.agg(F.count("*")).scalar()
    product = F.try_mod(F.col("user_id") * 31 + F.dayofmonth("ts"), parts)
    user_day = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
    clicks = source.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart")
        .when(F.col("event_type") == "error", "remove_from_cart")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        product.alias("product_id"),
        (product % 6 + 1001).alias("category_id"),
        F.col("value").cast("decimal(10,2)").alias("price"),
        F.when(F.lit(not gaps) | (F.col("event_id") % 13 != 0), F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 5 != 0, hyphenated(F.md5(user_day))).alias("user_session"),
    )
    if not products:
        return conform(clicks)
    part = part.select(
        F.col("p_partkey").alias("product_id"), "p_name", "p_brand", "p_type"
    )
    code = F.concat(
        F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))),
        F.lit("."),
        F.replace("p_name", F.lit(" "), F.lit("_")),
    )
    return conform(
        clicks.join(part, "product_id", "left").select(
            *clicks.columns,
            F.when(F.col("product_id") % 10 != 0, code).alias("category_code"),
            F.when(F.col("product_id") % 7 != 0, F.col("p_brand")).alias("brand"),
        )
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as purchases: years of history, one event per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return conform(
        orders.select(
            F.col("o_orderdate").cast("timestamp").alias("event_time"),
            F.lit("purchase").alias("event_type"),
            F.col("o_orderkey").alias("product_id"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("price"),
            F.col("o_custkey").alias("user_id"),
        )
    )


def unchecked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as a loader would deliver them; in turn, each rule is broken by some.

    A document is an event: its source the event type, the hash of its text the brand, its
    characters the price. The remainder of the doc_id decides which column is spoilt.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turn = F.col("doc_id") % 24

    def spoilt(plain: Column, **by_turn: str | None) -> Column:
        cases = plain
        for at, text in by_turn.items():
            value = F.lit(text).cast("string")
            cases = F.when(turn == int(at.removeprefix("turn")), value).otherwise(cases)
        return cases

    digits = F.md5(F.col("doc_id").cast("string"))
    session = (
        F.when(turn == 14, F.concat(hyphenated(digits), F.lit("\n")))
        .when(turn == 15, F.concat(F.lit("{"), F.upper(digits), F.lit("}")))
        .when(turn == 16, hyphenated(digits))
        .otherwise(F.upper(digits))
    )
    clock = F.timestamp_seconds(F.col("doc_id") + 1_700_000_000)
    price = F.concat((F.col("n_chars") % 1000).cast("string"), F.lit(".125"))
    return documents.select(
        spoilt(F.date_format(clock, "yyyy-MM-dd HH:mm:ss"), turn1="yesterday", turn2=None).alias(
            "event_time"
        ),
        spoilt(F.col("source"), turn3=None, turn4="a" * 31).alias("event_type"),
        spoilt(F.col("doc_id").cast("string"), turn5="x12", turn6=None).alias("product_id"),
        spoilt((F.col("doc_id") % 9).cast("string"), turn7="c", turn17=None).alias("category_id"),
        spoilt(F.concat("lang", F.lit("."), "source"), turn8="b" * 256).alias("category_code"),
        spoilt(F.md5("text"), turn9="c" * 256, turn18="d" * 255 + "  ").alias("brand"),
        spoilt(price, turn10="-0.01", turn11="free", turn19=None).alias("price"),
        spoilt((F.col("doc_id") % 97).cast("string"), turn12=None, turn20="u7").alias("user_id"),
        spoilt(session, turn13="none", turn21=None).alias("user_session"),
    )


def mixed_csv(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """``orders`` as CSV files of three kinds in one folder; the folder.

    The columns of the second kind come in another order; the third lacks some, and its
    lines end with two fields that its header does not have.
    """
    orders = order_events(spark, sf_dir)
    kind = F.col("product_id") % 3
    plain = ["event_time", "event_type", "product_id", "price", "user_id"]
    stamped = orders.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))
    orders = stamped.withColumn("category_id", F.lit(7))
    swapped = ["user_id", "event_type", "price", "event_time", "category_id", "product_id"]
    too_long = F.concat_ws(",", F.col("user_id"), F.lit("x"), F.lit("y")).alias("user_id")
    frames = (
        orders.filter(kind == 0).select(*plain, "category_id"),
        orders.filter(kind == 1).select(*swapped),
        orders.filter(kind == 2).select(*plain[:-1], too_long),
    )
    for frame in frames:
        # without quotes the commas of a value make fields
        writer = frame.write.mode("append").option("header", True).option("quote", "")
        writer.csv(folder)
    return folder
