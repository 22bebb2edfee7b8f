"""Sessions added part by part equal those of all events at once."""

import random
import shutil
from datetime import date, datetime, timedelta

import pytest
from compare import spark_result

from footfall.operators.history import SessionHistory
from footfall.operators.sessions import session_steps, sessionize
from footfall.settings import fresh_dir
from footfall.sources.versions import Conflict, Versions


def local(folder):
    return folder.removeprefix("file:")


@pytest.fixture
def folder(spark):
    return fresh_dir(spark, "history")


def random_events(make_events, seed, days=70, n=400, gap=timedelta(minutes=30)):
    """Bursts around midnight and month ends, exactly a gap apart or a microsecond more."""
    pick = random.Random(seed)
    steps = [timedelta(0), gap, gap + timedelta(microseconds=1), gap / 3, 5 * gap, timedelta(days=9)]
    rows, at = [], {}
    for i in range(n):
        user = pick.choice([1, 1, 1, 2, 3, 4])
        start = datetime(2024, 1, 1) + timedelta(days=pick.randrange(days)) - gap * pick.randint(0, 3)
        time = at.get(user, start) + pick.choice(steps) if pick.random() < 0.8 else start
        at[user] = time
        rows.append(
            dict(
                event_time=time,
                user_id=user,
                event_type=pick.choice(["view", "cart", "purchase"]),
                product_id=i,
                user_session=pick.choice([None, None, "a", "b"]),
            )
        )
    return make_events(*rows)


def same(history, events, gap=timedelta(minutes=30)):
    assert spark_result(history.sessionized()) == spark_result(sessionize(events, gap))
    assert spark_result(history.session_steps()) == spark_result(session_steps(events, gap=gap))


def in_month(events, *months):
    return events.filter(f"date_format(event_time, 'yyyy-MM') IN {(*months, '')}")


def months_of(events):
    found = events.selectExpr("date_format(event_time, 'yyyy-MM') m").distinct().collect()
    return sorted(r.m for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_months_in_any_order(spark, make_events, folder, seed):
    events = random_events(make_events, seed).cache()
    months = months_of(events)
    random.Random(seed).shuffle(months)
    history = SessionHistory(spark, folder)
    for month in months:
        assert history.add(in_month(events, month)) == [month]
    same(history, events)


def test_days_and_an_odd_gap(spark, make_events, folder):
    """A slot of seven minutes lies across midnight; late events go into days that exist."""
    gap = timedelta(minutes=7)
    events = random_events(make_events, 9, days=4, n=200, gap=gap).cache()
    history = SessionHistory(spark, folder, gap, period="day")
    late = events.filter("product_id % 5 = 0")
    history.add(events.filter("product_id % 5 <> 0"))
    history.add(late)
    same(history, events, gap)


def test_replaced_month(spark, make_events, folder):
    events = random_events(make_events, 5).cache()
    first, *later = months_of(events)
    history = SessionHistory(spark, folder)
    history.add(events)
    kept = events.filter("product_id % 3 <> 0")
    history.replace(in_month(kept, later[0]))
    same(history, in_month(events, first, *later[1:]).union(in_month(kept, later[0])))
    history.replace(in_month(events, later[0]))
    same(history, events)


def test_appending_reads_no_older_month(spark, make_events, folder):
    """The files of older events are gone; appending and backfilling work all the same."""
    events = random_events(make_events, 7, days=100).cache()
    months = months_of(events)
    history = SessionHistory(spark, folder)
    history.add(in_month(events, *months[:2]))
    for table in ("rows", "steps"):
        shutil.rmtree(f"{local(folder)}/{table}")
    history.add(in_month(events, *months[3:]))
    history.add(in_month(events, months[2]))
    read = history.sessionized(first=date.fromisoformat(f"{months[2]}-01"))
    want = sessionize(events).filter(f"event_time >= '{months[2]}-01'")
    assert spark_result(read) == spark_result(want)


def test_ranges_read_their_parts_only(spark, make_events, folder):
    events = random_events(make_events, 3)
    history = SessionHistory(spark, folder, period="day")
    history.add(events)
    day = date(2024, 1, 20)
    read = history.sessionized(day, day + timedelta(days=1))
    assert {f.split("event_day=")[1][:10] for f in read.inputFiles()} <= {"2024-01-20", "2024-01-21"}
    want = sessionize(events).filter("to_date(event_time) BETWEEN '2024-01-20' AND '2024-01-21'")
    assert spark_result(read) == spark_result(want)
    # nothing was put between other parts: no join on the way
    assert "Join" not in read._jdf.queryExecution().optimizedPlan().toString()


def test_settings_are_kept(spark, make_events, folder):
    SessionHistory(spark, folder).add(random_events(make_events, 1, n=5))
    with pytest.raises(ValueError, match="was written with"):
        SessionHistory(spark, folder, timedelta(hours=1)).add(random_events(make_events, 1, n=5))


def test_empty(spark, make_events, folder):
    history = SessionHistory(spark, folder)
    assert history.add(make_events()) == [] and history.parts() == []


# -- versions --------------------------------------------------------------------------


def test_a_change_is_seen_whole_or_not_at_all(spark, folder):
    versions = Versions(spark, folder)
    with versions.change() as change:
        change.write("a", spark.range(3))
        change.write("b", spark.range(4).selectExpr("id", "id % 2 AS k"), by="k")
    with pytest.raises(RuntimeError, match="half-way"):
        with versions.change() as change:
            change.write("a", spark.range(30))
            change.write("b", spark.range(40).selectExpr("id", "id % 2 AS k"), by="k")
            raise RuntimeError("half-way")
    assert versions.read("a").count() == 3 and versions.read("b").count() == 4
    old = versions.manifest()
    with versions.change() as change:
        assert change.write("b", spark.range(10, 12).selectExpr("id", "1 AS k"), by="k") == ["1"]
        assert change.read("b").count() == 4 and versions.read("b", ["1"]).count() == 2
    assert sorted(r.id for r in versions.read("b").collect()) == [0, 2, 10, 11]
    assert sorted(r.id for r in versions.read("b", manifest=old).collect()) == [0, 1, 2, 3]
    assert versions.read("b", ["7"]).count() == 0
    with pytest.raises(ValueError, match="no table"):
        versions.read("c")


def test_the_second_of_two_changes_is_refused(spark, folder):
    versions = Versions(spark, folder)
    one, other = versions.change(), versions.change()
    one.write("a", spark.range(1))
    other.write("a", spark.range(2))
    assert one.commit() == 1
    with pytest.raises(Conflict):
        other.commit()
    assert versions.read("a").count() == 1


def test_tidy(spark, folder):
    versions = Versions(spark, folder)
    for n in range(1, 5):
        with versions.change() as change:
            change.write("a", spark.range(n))
    versions.change().write("a", spark.range(9))
    versions.tidy(keep=2)
    assert versions.numbers() == [3, 4]
    assert len(versions._listed("a", "batch=*")) == 2
    assert versions.read("a").count() == 4
    assert versions.read("a", manifest=versions.manifest(3)).count() == 3
