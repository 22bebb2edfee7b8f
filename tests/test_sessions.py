import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from footfall.operators.sessions import session_slots, session_steps, session_summary, sessionize
from footfall.sources.adapters import shop_events


def sessions_of(df):
    """[(user, time, session number)] in order."""
    return sorted(
        (r.user_id, r.event_time, int(r.calculated_session_id.split("_s")[1]))
        for r in df.collect()
    )


def test_gap_boundary(make_events):
    df = make_events(
        *(dict(event_time=f"2024-01-01 {t}") for t in ("00:00:00", "00:30:00", "01:00:00.000001"))
    )
    assert [n for *_, n in sessions_of(sessionize(df))] == [1, 1, 2]


def test_ties_share_a_session(make_events):
    times = ("00:00:00", "02:00:00", "02:00:00", "02:10:00")
    df = make_events(*(dict(event_time=f"2024-01-01 {t}") for t in times))
    assert [n for *_, n in sessions_of(sessionize(df))] == [1, 2, 2, 2]


def test_effective_id_prefers_the_frontend(make_events):
    df = sessionize(
        make_events(
            dict(event_time="2024-01-01 00:00:00", user_id=7),
            dict(event_time="2024-01-01 00:01:00", user_id=7, user_session="raw"),
        )
    ).orderBy("event_time")
    assert [(r.calculated_session_id, r.effective_session_id) for r in df.collect()] == [
        ("7_s1", "7_s1"),
        ("7_s1", "raw"),
    ]


def test_output_columns(make_events):
    assert sessionize(make_events(dict(event_time="2024-01-01"))).columns == [
        "event_time", "event_type", "product_id", "category_id", "category_code", "brand",
        "price", "user_id", "raw_user_session", "calculated_session_id", "effective_session_id",
    ]


def brute_force(rows, gap):
    by_user = defaultdict(list)
    for user, time in rows:
        by_user[user].append(time)
    out = []
    for user, times in by_user.items():
        number, previous = 0, None
        for time in sorted(times):
            if previous is None or time - previous > gap:
                number += 1
            out.append((user, time, number))
            previous = time
    return sorted(out)


@pytest.mark.parametrize(
    "gap",
    [timedelta(minutes=30), timedelta(seconds=7), timedelta(microseconds=1), timedelta(hours=26)],
    ids=str,
)
def test_random_histories_against_brute_force(make_events, gap):
    """Dense, sparse and exactly-one-gap steps, around the epoch and after it."""
    rng = random.Random(str(gap))
    rows = []
    for user, start in enumerate([(1969, 12, 30), (2024, 2, 28), (1970, 1, 1)]):
        time = datetime(*start)
        for _ in range(400):
            steps = [gap, gap, gap + timedelta(microseconds=1), gap * rng.random(), gap * 3]
            step = rng.choice(steps)
            time += rng.choice([step, timedelta(0)])
            rows.append((user, time))
    df = make_events(*(dict(user_id=u, event_time=t) for u, t in rows))
    assert sessions_of(sessionize(df, gap)) == brute_force(rows, gap)


def test_one_user_with_a_third_of_all_rows(spark):
    """The hot user's rows equal the plain window's, and reach the window as few slots."""
    events = shop_events(spark, f"{TESTDATA}/sf0.01", products=False)
    events = events.withColumn(
        "user_id", F.when(F.col("product_id") % 3 == 0, 0).otherwise(F.col("user_id"))
    )
    rows = [(r.user_id, r.event_time) for r in events.select("user_id", "event_time").collect()]
    assert sum(u == 0 for u, _ in rows) > len(rows) / 4
    assert sessions_of(sessionize(events)) == brute_force(rows, timedelta(minutes=30))
    assert session_slots(events).filter("user_id = 0").count() <= 30 * 48


def test_gap_must_be_positive(make_events):
    with pytest.raises(ValueError):
        sessionize(make_events(dict(event_time="2024-01-01")), timedelta(0))


def test_rows_and_session_starts_are_conserved(spark):
    events = shop_events(spark, f"{TESTDATA}/sf0.01", products=False)
    out = sessionize(events)
    assert out.count() == events.count()
    per_user = out.groupBy("user_id").agg(
        F.countDistinct("calculated_session_id").alias("n"),
        F.max(F.split_part("calculated_session_id", F.lit("_s"), F.lit(2)).cast("int")).alias(
            "last"
        ),
    )
    assert per_user.filter("n <> last").count() == 0


def test_steps_from_raw_and_sessionized_events_agree(spark):
    events = shop_events(spark, f"{TESTDATA}/sf0.01", products=False)
    raw, sessionized = session_steps(events), session_steps(sessionize(events))
    assert raw.exceptAll(sessionized).count() == 0
    assert raw.count() == sessionized.count()


@pytest.mark.parametrize("source", [lambda df: df, sessionize], ids=["raw", "sessionized"])
def test_frontend_id_that_looks_calculated(make_events, source):
    """Equal effective ids of a user are one session, wherever they come from."""
    rows = [
        dict(event_time="2024-01-01 10:00"),
        dict(event_time="2024-01-01 18:00", event_type="cart", user_session="1_s1"),
        dict(event_time="2024-01-01 18:05", user_id=2, user_session="1_s1"),
    ]
    steps = session_steps(source(make_events(*rows))).orderBy("user_id").collect()
    assert [(r.user_id, r.effective_session_id) for r in steps] == [(1, "1_s1"), (2, "1_s1")]
    assert steps[0].min_cart_time == datetime(2024, 1, 1, 18)


def test_session_start_and_end(make_events):
    row = session_steps(
        make_events(
            dict(event_time="2024-01-01 10:00", event_type="remove_from_cart"),
            dict(event_time="2024-01-01 10:05"),
            dict(event_time="2024-01-01 10:09", event_type="cart"),
        )
    ).first()
    assert row.session_start_time == datetime(2024, 1, 1, 10)
    assert row.session_end_time == datetime(2024, 1, 1, 10, 9)
    assert row.min_purchase_time is None


@pytest.mark.parametrize("seed", range(3))
def test_summary_with_mixed_gaps_equals_a_scan(make_events, seed):
    """A gap per event type; pauses of exactly a gap, and of a microsecond more."""
    pick, minute, tick = random.Random(seed), timedelta(minutes=1), timedelta(microseconds=1)
    gaps = {"cart": 45 * minute, "purchase": 7 * minute}
    pauses = [timedelta(0), tick, 7 * minute, 7 * minute + tick, 20 * minute, 45 * minute, 45 * minute + tick, 90 * minute]
    rows, at = [], datetime(2024, 1, 31, 22)
    for _ in range(300):
        at += pick.choice(pauses)
        kind = pick.choice(["view", "cart", "purchase", "other"])
        rows.append(dict(event_time=at, user_id=pick.choice([1, 1, 2]), event_type=kind, price="1.25"))
    want, open_ = [], {}
    for r in rows:
        user, time, kind = r["user_id"], r["event_time"], r["event_type"]
        if user not in open_ or time > open_[user]["reach"]:
            open_[user] = dict(reach=time, start=time, kinds=[])
            want.append((user, open_[user]))
        session = open_[user]
        session["reach"] = max(session["reach"], time + gaps.get(kind, 20 * minute))
        session["end"] = time
        session["kinds"].append(kind)
    summary = session_summary(make_events(*rows), gaps, 20 * minute)
    got = sorted(tuple(r) for r in summary.collect())
    assert got == sorted(
        (u, s["start"], s["end"], len(s["kinds"]), *(s["kinds"].count(k) for k in ("view", "cart", "purchase")),
         Decimal("1.25") * s["kinds"].count("purchase"))
        for u, s in want
    )


def test_summary_of_one_gap_has_the_sessions_of_the_numbering(make_events):
    events = make_events(*(dict(event_time=f"2024-01-0{d} 0{h}:{m}:00", user_id=u) for d in (1, 2) for h in (1, 2) for m in (10, 40, 41) for u in (1, 2)))
    by_number = sessionize(events).select("user_id", "calculated_session_id").distinct().count()
    assert session_summary(events).count() == by_number
    with pytest.raises(ValueError):
        session_summary(events, {"view": timedelta(0)})
