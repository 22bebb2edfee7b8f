"""Sets of users: bitmaps and sketches against counting the events; grouped medians."""

import random
import shutil
from collections import defaultdict
from datetime import date, datetime, timedelta
from statistics import median

import pytest
from compare import spark_result
from pyspark.sql import functions as F

from footfall.functions.median import total_and_median, totals_and_medians
from footfall.operators import sketches
from footfall.operators.audience import GROUPS, Audience, number_users
from footfall.operators.funnel import time_to_buy
from footfall.operators.sessions import sessionize
from footfall.settings import fresh_dir


def random_events(make_events, seed, n=500, users=40):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(
            dict(
                event_time=datetime(2024, 1, 1) + timedelta(minutes=pick.randrange(60 * 24 * 75)),
                # ids far apart, and one user with a third of all events
                user_id=pick.choice([7, pick.randrange(users) * 10**12 - 5 * 10**12]) if i % 3 else 7,
                event_type=pick.choice(["view", "view", "cart", "purchase", "remove_from_cart"]),
                category_code=pick.choice([None, "a.x", "a.y", "b"]),
                brand=pick.choice([None, "m", "n"]),
                user_session=pick.choice([None, "s1", "s2"]),
            )
        )
    return make_events(*rows)


@pytest.fixture
def folder(spark):
    return fresh_dir(spark, "audience")


def in_python(events):
    return [(r.user_id, r.event_time.date(), r.category_code, r.event_type) for r in events.collect()]


@pytest.mark.parametrize("parts", [1, 3])
def test_ranges_and_rolling_equal_distinct_counts(spark, make_events, folder, parts):
    events = random_events(make_events, parts).cache()
    sets = Audience(spark, folder)
    for part in range(parts):  # days come in any order, and twice
        sets.add(events.filter(F.pmod(F.hash("event_time"), F.lit(parts)) == part))
    rows = in_python(events)
    first, last = date(2024, 1, 20), date(2024, 2, 12)
    inside = [r for r in rows if first <= r[1] <= last]
    got = {r.top_category: tuple(r)[1:] for r in sets.of_range(first, last).collect()}
    for category in ("a", "b", "uncategorized", None):
        own = [r for r in inside if category is None or (r[2] or "uncategorized")[: len(category)] == category]
        kinds = (None, "view", "cart", "purchase")
        want = tuple(len({r[0] for r in own if k in (None, r[3])}) for k in kinds)
        assert got[category] == want
    got = {r.event_date: tuple(r)[1:] for r in sets.rolling(first, last).collect()}
    for day in (first + timedelta(days=i) for i in range((last - first).days + 1)):
        want = tuple(
            len({r[0] for r in rows if day - timedelta(days=w - 1) <= r[1] <= day}) for w in (1, 7, 30)
        )
        assert got.get(day, (0, 0, 0)) == want


def test_a_range_reads_its_months_and_no_events(spark, make_events, folder):
    sets = Audience(spark, folder)
    sets.add(random_events(make_events, 4))
    read = sets.daily(date(2024, 2, 3), date(2024, 2, 9))
    assert {f.split("event_month=")[1][:7] for f in read.inputFiles()} == {"2024-02"}
    shutil.rmtree(f"{folder.removeprefix('file:')}/numbers")
    assert sets.of_range(date(2024, 2, 3), date(2024, 2, 9)).count() > 0


def test_numbers_are_dense_and_never_change(spark):
    some = spark.range(0, 3000).select((F.col("id") * 7919).alias("user_id"))
    known = number_users(some.union(some)).cache()
    more = spark.range(2000, 9000).select((F.col("id") * 7919).alias("user_id"))
    new = number_users(more.unionByName(spark.createDataFrame([(None,)], "user_id long")), known)
    both = known.union(new).collect()
    assert len(both) == 9000 == len({r.user_id for r in both}) == len({r.number for r in both})
    assert max(r.number for r in both) < 9000 + 25 * GROUPS


# -- sketches -------------------------------------------------------------------


def steps_of(events, keys):
    """Users by the steps taken anywhere in a roll-up, from the events."""
    taken = defaultdict(lambda: defaultdict(set))
    for r in events.collect():
        cell = dict(
            event_date=r.event_time.date(),
            top_category=(r.category_code or "uncategorized").split(".")[0],
            brand=r.brand or "unknown",
        )
        taken[tuple(cell[k] for k in keys)][r.event_type].add(r.user_id)
    return {
        key: (len(t["view"]), len(t["view"] & t["cart"]), len(t["view"] & t["cart"] & t["purchase"]))
        for key, t in taken.items()
    }


@pytest.mark.parametrize("keys", [["event_date"], ["top_category", "brand"], ["brand"]])
def test_rollups_are_exact_while_small(make_events, keys):
    events = random_events(make_events, 8).cache()
    for source in (events, sessionize(events)):
        rolled = sketches.funnel_rollup(sketches.funnel_sketches(source), keys)
        got = {tuple(r[k] for k in keys): (r.view_users, r.cart_users, r.purchase_users) for r in rolled.collect()}
        assert got == steps_of(events, keys)


def test_error_of_large_sets_is_as_stated(spark):
    """512 entries: 4.4 % standard error of a set, more for an intersection; four of them."""
    n, lg = 60_000, 9
    types = F.element_at(F.array(F.lit("view"), F.lit("cart"), F.lit("purchase")), (F.col("k") + 1).cast("int"))
    events = (
        spark.range(n)
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        # all see, a half has a cart, a quarter buys
        .filter((F.col("id") % 4 >= F.col("k") * 2 - 1) | (F.col("k") == 0))
        .filter((F.col("k") < 2) | (F.col("id") % 4 == 3))
        .select(
            F.timestamp_seconds(1_704_067_200 + F.col("id") % 5 * 86400).alias("event_time"),
            types.alias("event_type"),
            F.lit(None).cast("string").alias("category_code"),
            F.lit(None).cast("string").alias("brand"),
            F.col("id").alias("user_id"),
            F.col("id").cast("string").alias("effective_session_id"),
        )
    )
    exact = steps_of(events, ["brand"])[("unknown",)]
    assert exact[0] == n and exact[2] == n // 4
    row = sketches.funnel_rollup(sketches.funnel_sketches(events, lg), ["brand"], lg).first()
    got = row.view_users, row.cart_users, row.purchase_users
    for estimate, size in zip(got, exact):
        assert abs(estimate - size) <= 4 * (n / size) ** 0.5 / 2 ** (lg / 2) * size
    sizes = sketches.funnel_sketches(events, lg).select(F.octet_length("view_users_sketch")).collect()
    assert max(r[0] for r in sizes) < 8 * 2**lg * 2 + 64


def test_levels(make_events):
    events = random_events(make_events, 2).cache()
    levels = sketches.by_levels(sketches.funnel_sketches(events))
    got = {(r.month, r.top_category, r.brand): r.view_users for r in levels.collect()}
    users = defaultdict(set)
    for r in events.filter("event_type = 'view'").collect():
        month = f"{r.event_time:%Y-%m}"
        category, brand = (r.category_code or "uncategorized").split(".")[0], r.brand or "unknown"
        for key in ((month, category, brand), (month, category, None), (month, None, None)):
            users[key].add(r.user_id)
    assert {k: n for k, n in got.items() if n} == {k: len(u) for k, u in users.items()}


# -- medians --------------------------------------------------------------------


def test_grouped_medians(spark):
    pick = random.Random(3)
    rows = []
    for group in [None, "a", "b", "c", *(f"g{i}" for i in range(200))]:
        # values of every size, from a microsecond to centuries
        for _ in range(pick.randint(1, 60)):
            rows.append((group, pick.choice([1, None]), pick.randrange(1 << pick.randint(1, 60)), pick.randint(1, 4)))
    rows += [("hot", 1, v % 977 << 30, 1) for v in range(5000)] + [("none", 1, None, 3)]
    df = spark.createDataFrame(rows, "g string, h int, v long, w long")
    got = {(r.g, r.h): (int(r.total), r.n, r.median) for r in totals_and_medians(df, ["g", "h"], "v", "w").collect()}
    values = defaultdict(list)
    for g, h, v, w in rows:
        if v is not None:
            values[g, h] += [v] * w

    def middle(v):
        low, high = sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]
        return (low + high) / 2.0

    assert got == {k: (sum(v), len(v), middle(v)) for k, v in values.items()}
    whole = total_and_median(df.filter("v IS NOT NULL"), "v", "w").first()
    every = [x for v in values.values() for x in v]
    assert (int(whole.total), whole.n, whole.median) == (sum(every), len(every), middle(every))


def test_time_to_buy_by_cell(make_events):
    events = random_events(make_events, 6, n=900, users=6).cache()
    raw = spark_result(time_to_buy(events, ["top_category"]))
    assert raw == spark_result(time_to_buy(sessionize(events), ["top_category"]))
    firsts = defaultdict(dict)
    for r in sessionize(events).collect():
        key = (r.category_code or "uncategorized").split(".")[0], r.user_id, r.effective_session_id
        firsts[key][r.event_type] = min(r.event_time, firsts[key].get(r.event_type, r.event_time))
    times = defaultdict(list)
    for key, at in firsts.items():
        if "view" in at and at.get("purchase", datetime.min) >= at["view"]:
            times[key[0]].append((at["purchase"] - at["view"]).total_seconds())
    got = {r.top_category: (r.buying_sessions, r.median_ttb_seconds) for r in time_to_buy(events, ["top_category"]).collect()}
    assert got == {c: (len(t), median(t)) for c, t in times.items()} and len(got) == 3
    with pytest.raises(ValueError, match="goes by some of"):
        time_to_buy(events, ["user_id"])
    with pytest.raises(ValueError, match="goes by some of"):
        time_to_buy(events, [])


def test_no_group_of_a_median_is_one_task(spark):
    """The plan ranks digits, and never rows, of a group."""
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id", F.lit(1).alias("w"))
    plan = totals_and_medians(df, ["g"], "id", "w")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "slot" in line
