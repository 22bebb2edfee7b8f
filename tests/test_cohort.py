import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from footfall.operators.cohort import (
    cohort_events,
    cohort_matrix,
    cohort_retention,
    cohort_retention_weekly,
)
from footfall.operators.sessions import sessionize
from footfall.plans.charts import heatmap_feed, weekly_cohort_chart, weekly_cohort_rates


def flat(df, *args, **kw):
    return [tuple(r) for r in cohort_retention(df, *args, **kw).collect()]


def test_iso_year_edges(make_events):
    days = ["2024-01-01", "2024-12-30", "2021-01-02"]
    rows = [dict(event_time=d, user_id=i) for i, d in enumerate(days)]
    assert [r[0] for r in flat(make_events(*rows), "W")] == ["2020-W53", "2024-W01", "2025-W01"]


def test_day_index_counts_24_hour_blocks(make_events):
    rows = [dict(event_time=t) for t in ("2024-01-01 20:00", "2024-01-02 19:59")]
    assert [r[:2] for r in flat(make_events(*rows), "D")] == [("2024-01-01", 0)]
    rows.append(dict(event_time="2024-01-02 20:00"))
    assert [r[:2] for r in flat(make_events(*rows), "D")] == [("2024-01-01", 0), ("2024-01-01", 1)]


def test_day_index_is_exact_to_the_microsecond(make_events):
    rows = [dict(event_time=t) for t in ("2024-01-01 00:00:00.9", "2024-01-02 00:00:00.899999")]
    assert [r[1] for r in flat(make_events(*rows), "D")] == [0]


def test_month_index(make_events):
    rows = [dict(event_time=t) for t in ("2023-12-31", "2024-01-01")]
    assert [r[:2] for r in flat(make_events(*rows), "m")] == [("2023-12", 0), ("2023-12", 1)]


def test_filter_defines_the_cohort(make_events):
    rows = [
        dict(event_time="2024-01-01"),
        dict(event_time="2024-01-15", event_type="purchase"),
    ]
    assert flat(make_events(*rows), "W", "purchase") == [("2024-W03", 0, 1, 1, 100.0)]


def test_bad_granularity(make_events):
    with pytest.raises(ValueError):
        cohort_retention(make_events(dict(event_time="2024-01-01")), "Q")


def test_text_times_are_parsed(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "user_id bigint, event_time string")
    assert flat(df, "D") == [("2024-01-01", 0, 1, 1, 100.0)]


@pytest.mark.parametrize("granularity", ["D", "W", "M"])
def test_times_without_zone(make_events, granularity):
    df = make_events(dict(event_time="2024-01-01 20:00"), dict(event_time="2024-02-02 20:00"))
    naive = df.withColumn("event_time", df.event_time.cast("timestamp_ntz"))
    assert flat(naive, granularity) == flat(df, granularity)
    assert sessionize(naive).count() == cohort_events(naive, granularity).count() == 2


def test_rate_tie_rounds_up(make_events):
    rows = [dict(event_time="2024-01-01", user_id=u) for u in range(32)]
    rows.append(dict(event_time="2024-01-08", user_id=0))
    assert flat(make_events(*rows), "W")[1] == ("2024-W01", 1, 1, 32, 3.13)


def brute_force(rows, granularity):
    first = {}
    for user, time in rows:
        first[user] = min(first.get(user, time), time)
    users = defaultdict(set)
    for user, time in rows:
        f = first[user]
        if granularity == "D":
            key = f.strftime("%Y-%m-%d"), (time - f) // timedelta(days=1)
        elif granularity == "W":
            monday = lambda t: (t - timedelta(days=t.weekday())).date()
            key = f.strftime("%G-W%V"), (monday(time) - monday(f)).days // 7
        else:
            key = f.strftime("%Y-%m"), (time.year - f.year) * 12 + time.month - f.month
        users[key].add(user)
    return {key: (len(u), len(users[key[0], 0])) for key, u in users.items()}


@pytest.mark.parametrize("granularity", ["D", "W", "M"])
def test_random_histories_against_brute_force(make_events, granularity):
    rng = random.Random(granularity)
    rows = [
        (user, datetime(2023, 11, 20) + timedelta(seconds=rng.random() * 86400 * 60))
        for user in range(12)
        for _ in range(rng.choice([1, 5, 40]))
    ]
    # one user with a third of all rows
    rows += [(99, datetime(2023, 12, 1) + timedelta(hours=7 * i)) for i in range(len(rows) // 2)]
    got = flat(make_events(*(dict(user_id=u, event_time=t) for u, t in rows)), granularity)
    assert {(g, i): (n, size) for g, i, n, size, _ in got} == brute_force(rows, granularity)
    assert all(rate == 100.0 for _, i, _, _, rate in got if i == 0)
    assert sum(n for _, i, n, _, _ in got if i == 0) == len({u for u, _ in rows})


def test_weekly_mart_from_raw_and_sessionized(make_events):
    df = make_events(dict(event_time="2024-01-03"), dict(event_time="2024-01-08"))
    for source in (df, sessionize(df)):
        rows = cohort_retention_weekly(source).collect()
        assert [tuple(r)[1:] for r in rows] == [
            ("Week 0", 0, 1, 1, 100.0), ("Week 1", 1, 1, 1, 100.0),
        ]
        assert str(rows[0].cohort_week) == "2024-01-01"


def test_cohort_events_keep_every_row(make_events):
    df = make_events(*(dict(event_time=d) for d in ("2024-01-03", "2024-01-03", "2024-02-08")))
    rows = cohort_events(df, "M").orderBy("event_time").collect()
    assert [(r.cohort_group, r.event_period, r.cohort_index) for r in rows] == [
        ("2024-01", "2024-01", 0), ("2024-01", "2024-01", 0), ("2024-01", "2024-02", 1),
    ]


@pytest.fixture(scope="module")
def monthly(make_events):
    rows = [("2024-01-05", 1), ("2024-03-05", 1), ("2024-01-09", 2), ("2024-02-01", 3)]
    return cohort_retention(make_events(*(dict(event_time=t, user_id=u) for t, u in rows)), "M")


def test_matrix(monthly):
    matrix = cohort_matrix(monthly, "active_users")
    assert matrix.columns == ["cohort_group", "0", "2"]
    assert [tuple(r) for r in matrix.collect()] == [
        ("2024-01", 2, 1), ("2024-02", 1, None),
    ]
    rates = cohort_matrix(monthly, "retention_rate", prefix="month_")
    assert rates.first().asDict() == {"cohort_group": "2024-01", "month_0": 100.0, "month_2": 50.0}
    assert cohort_matrix(monthly.limit(0), "active_users").columns == ["cohort_group"]


def test_heatmap_feed(monthly):
    feed = heatmap_feed(monthly).orderBy("cohort_group", "cohort_index").collect()
    assert len(feed) == 6
    assert tuple(feed[0])[2:] == ("2024-01 (N=2)", "Period 0", 100.0, "100.0%")
    assert tuple(feed[1])[2:] == ("2024-01 (N=2)", "Period 1", None, "")
    assert tuple(feed[2])[4:] == (50.0, "50.0%")
    labels = heatmap_feed(monthly, "Week", gap="  ").first()
    assert (labels.row_label, labels.column_label) == ("2024-01  (N=2)", "Week 0")


def test_weekly_chart_rounds_to_one_place(make_events):
    rows = [dict(event_time="2024-01-01", user_id=u) for u in range(3)]
    rows.append(dict(event_time="2024-01-08", user_id=0))
    assert tuple(weekly_cohort_chart(weekly_cohort_rates(make_events(*rows))).first()) == ("2024-W01", 100.0, 33.3)
