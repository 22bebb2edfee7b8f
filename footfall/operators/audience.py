"""Distinct users of any range of days, from one bitmap per day.

Daily numbers of distinct users do not add up over a week: who came twice would count twice.
Here every day keeps the set of its users as bitmaps of 32,768 bits, one bit per user, which
merge by OR. Users get dense numbers first, so that bitmaps are well filled whatever the ids.
Counts are exact: a range of days reads its days' bitmaps, never the events.

Tables of the folder (see ``sources.versions``):

    numbers   user_id, number                                       by wave, one per addition
    daily     day, category, kind of event, bucket of users, bits   by month

A set takes an eighth of a byte per user at most, per day, category and kind. For cells so
many and small that this is too much see ``operators.sketches``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions.calendar import day
from footfall.operators.funnel import top_category
from footfall.schema import CART, PURCHASE, VIEW
from footfall.sources.events import MONTH
from footfall.sources.versions import Change, Versions

# Users are numbered in so many groups at once; the numbers of a group are that far apart.
GROUPS = 1024
ANY = "any"
KINDS = {ANY: "users", VIEW: "view_users", CART: "cart_users", PURCHASE: "purchase_users"}
WIDTHS = {"dau": 1, "wau": 7, "mau": 30}
NUMBERS, DAILY, WAVE = "numbers", "daily", "wave"
CELL = ["event_date", "top_category", "kind"]


def number_users(users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user_id, number) of the users that ``known`` has not numbered yet.

    Users fall into groups by hash and are counted on in each, so there is no global order
    and numbers stay dense: the largest is hardly more than the number of users.
    """
    ids = users.select("user_id").filter("user_id IS NOT NULL").distinct()
    group = F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("group")
    if known is not None:
        ids = ids.join(known.select("user_id"), "user_id", "left_anti")
    placed = ids.select("user_id", group).withColumn(
        "place", F.row_number().over(Window.partitionBy("group").orderBy("user_id")) - 1
    )
    if known is not None:
        # a row per group
        taken = known.groupBy(group).agg(F.count("*").alias("taken"))
        placed = placed.join(F.broadcast(taken), "group", "left").withColumn(
            "place", F.col("place") + F.coalesce("taken", F.lit(0))
        )
    return placed.select(
        "user_id", (F.col("place").cast("long") * GROUPS + F.col("group")).alias("number")
    )


def daily_bitmaps(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """(event_date, top_category, kind, bucket, bits): users of each day as bitmaps.

    Events shrink to distinct (user, day, category, type) before they meet the numbers.
    """
    kinds = F.array(F.lit(ANY), F.when(F.col("event_type").isin(VIEW, CART, PURCHASE), F.col("event_type")))
    seen = events.select(
        "user_id", day("event_time").alias("event_date"), top_category().alias("top_category"), "event_type"
    ).distinct()
    each = seen.select(
        "user_id", "event_date", "top_category", F.explode(F.array_compact(kinds)).alias("kind")
    ).distinct()
    # one row per user, day, category and kind, so a hot user is no hot key
    placed = each.join(numbers, "user_id")
    # bucket numbers count from 1
    return placed.groupBy(*CELL, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def _merged(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_users(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct users of all bitmaps of a key together."""
    return _merged(bitmaps, keys).groupBy(*keys).agg(
        F.sum(F.bitmap_count("bits")).alias("users")
    )


class Audience:
    """The published sets of users; days are added as they come, in any order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.versions = Versions(spark, folder)

    def add(self, events: DataFrame) -> None:
        """Add events. Days that are there already grow by the new ones' users."""
        with self.versions.change() as change:
            self._number(change, events)
            month = F.date_format("event_date", "yyyy-MM")
            fresh = daily_bitmaps(events, change.read(NUMBERS).select("user_id", "number"))
            fresh = fresh.withColumn(MONTH, month)
            columns = fresh.columns
            known = change.parts(DAILY)
            if known:
                # at most a row per month
                months = events.select(F.date_format("event_time", "yyyy-MM")).distinct()
                touched = {r[0] for r in months.collect()} & set(known)
                held = change.read(DAILY, sorted(touched)).select(*columns)
                fresh = _merged(fresh.unionByName(held), [*CELL, MONTH])
            change.write(DAILY, fresh.hint("rebalance", MONTH), by=MONTH)

    def _number(self, change: Change, events: DataFrame) -> None:
        waves = change.parts(NUMBERS)
        known = change.read(NUMBERS) if waves else None
        wave = F.lit(f"{len(waves):06d}").alias(WAVE)
        change.write(NUMBERS, number_users(events, known).select("*", wave), by=WAVE)

    def daily(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Bitmaps of the days from one to another; only their months are read."""
        manifest = self.versions.manifest()
        known = sorted(manifest["tables"][DAILY]["parts"])
        low, high = (d and d.strftime("%Y-%m") for d in (first, last))
        months = [m for m in known if (not low or m >= low) and (not high or m <= high)]
        found = self.versions.read(DAILY, months, manifest).drop(MONTH)
        if first:
            found = found.filter(F.col("event_date") >= F.lit(first))
        if last:
            found = found.filter(F.col("event_date") <= F.lit(last))
        return found

    def of_range(self, first: date, last: date) -> DataFrame:
        """Distinct users of a range of days: any event, views, carts and purchases.

        One row per top category, and one with a NULL category for all of them together.
        """
        bitmaps = self.daily(first, last)
        # sets of the categories first: the total then merges these few
        merged = _merged(bitmaps, ["top_category", "kind"])
        total = merged.withColumn("top_category", F.lit(None).cast("string"))
        counted = count_users(merged.unionByName(total), ["top_category", "kind"])
        return counted.groupBy("top_category").agg(
            *(
                F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("users"))), F.lit(0)).alias(name)
                for kind, name in KINDS.items()
            )
        )

    def rolling(self, first: date, last: date) -> DataFrame:
        """Users active on each day, in the 7 and in the 30 days that end with it.

        A row for every day of the range with events in its 30 days.
        """
        widest = max(WIDTHS.values())
        bitmaps = self.daily(date.fromordinal(first.toordinal() - widest + 1), last)
        days = _merged(bitmaps.filter(F.col("kind") == ANY), ["event_date"])
        counted = None
        for name, width in WIDTHS.items():
            ends = F.sequence(
                F.greatest("event_date", F.lit(first)),
                F.least(F.date_add("event_date", width - 1), F.lit(last)),
            )
            # a sequence would run backwards where the set belongs to no day of the range
            reached = days.filter(F.date_add("event_date", width - 1) >= F.lit(first))
            of_days = reached.select(F.explode(ends).alias("day"), "bucket", "bits")
            users = count_users(of_days, ["day"]).withColumnRenamed("users", name)
            counted = users if counted is None else counted.join(users, "day", "full")
        zero = (F.coalesce(n, F.lit(0)).alias(n) for n in WIDTHS)
        return counted.select(F.col("day").alias("event_date"), *zero)
