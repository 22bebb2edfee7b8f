"""Shapes of the plans that matter at scale."""

import re
from datetime import date

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from footfall.operators.cohort import cohort_retention, cohort_retention_weekly
from footfall.operators.funnel import funnel_overall, funnel_summary, funnel_users
from footfall.operators.kpi import kpi_daily, kpi_trends
from footfall.operators.sessions import session_steps, sessionize
from footfall.settings import shared_dir, shuffle_partitions
from footfall.sources.adapters import order_events, shop_events
from footfall.sources.events import by_month, read_events, write_events

SF = f"{TESTDATA}/sf0.01"


@pytest.fixture
def shop(spark):
    """Clicks under plans for data too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield shop_events(spark, SF, products=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def exchange_keys(text: str) -> list[set[str]]:
    found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    return [{re.sub(r"#\d+L?$", "", k.strip()) for k in keys.split(",")} for keys in found]


def window_input_keys(text: str) -> list[str]:
    return re.findall(r"Window \[.*?\], \[(\w+)#", text)


def test_rows_are_never_shuffled_by_user_alone(shop):
    """Only the per-slot summary meets by user; the rows meet by user and slot."""
    text = plan(sessionize(shop))
    rows, *summary = exchange_keys(text)
    assert rows == {"user_id", "slot"}
    assert {"user_id"} in summary
    by_user = text.split("Window [sum(starts")[1]
    assert "HashAggregate" in by_user.split("Scan parquet")[0]


def test_marts_aggregate_before_the_session_lookup(shop):
    for df in (session_steps(shop), kpi_daily(shop)):
        left = plan(df).split("SortMergeJoin")[1]
        assert left.index("HashAggregate") < left.index("Scan parquet")


def test_no_expand_no_cross_join_no_python(shop):
    for df in (
        funnel_overall(session_steps(shop)),
        funnel_summary(shop),
        kpi_daily(shop),
        kpi_trends(shop),
        funnel_users(shop),
        cohort_retention(shop, "D"),
    ):
        text = plan(df)
        for node in ("Expand", "CartesianProduct", "NestedLoop", "Python", "Pandas"):
            assert node not in text, node


def test_funnel_reads_the_session_steps_once(shop):
    text = final_plan(funnel_overall(session_steps(shop)))
    assert text.count("ReusedExchange") >= 2
    # rows with and without a frontend session, slot summary; the branch for the time to
    # buy reads the shuffled steps of the other
    assert text.count("FileScan") == 3


def test_only_the_middle_slots_are_broadcast(shop):
    text = final_plan(funnel_overall(session_steps(shop)))
    assert text.count("BroadcastHashJoin") == 2
    # what is ranked are slots of a histogram, three times as many as a digit has at most
    ranked = re.findall(r"Window \[sum\(slot_n.*?\[(\w+)#\d+L? ASC", text)
    assert set(ranked) == {"slot"} and len(ranked) >= 3


def test_session_join_disappears_where_unused(shop):
    text = plan(cohort_retention_weekly(sessionize(shop)))
    assert "Join" not in text and text.count("FileScan") == 1


def test_cohorts_need_no_join(shop):
    for granularity in "DWM":
        assert "Join" not in plan(cohort_retention(shop, granularity))


def test_scans_read_only_the_needed_columns(shop):
    def read(df):
        return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", plan(df))[1]))

    assert read(cohort_retention(shop, "W")) == {"ts", "user_id"}
    assert read(funnel_users(shop)) == {"user_id", "event_type"}
    assert read(kpi_trends(shop)) == {"ts", "user_id", "event_type", "value"}


def test_event_filter_reaches_the_scan(spark):
    raw = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "event_time")
    text = plan(cohort_retention(raw, "D", "purchase"))
    assert "EqualTo(event_type,purchase)" in text


@pytest.mark.parametrize("mart", [kpi_daily, funnel_summary])
def test_day_ranges_prune_month_folders(spark, tmp_path, mart):
    path = f"file:{tmp_path}/by_month"
    days = (date(1996, 2, 20), date(1996, 3, 10))
    write_events(order_events(spark, SF), path)
    raw = read_events(spark, path, fmt="parquet", keep_month=True)
    pruned = re.findall(r"PartitionFilters: \[(.*?)\], ", plan(mart(raw, days=days)))
    # the slot summary reads all months: sessions depend on the whole history
    assert any("event_month" not in filters for filters in pruned)
    assert any("1996-02" in filters and "1996-03" in filters for filters in pruned)

    by_month(sessionize(raw)).write.partitionBy("event_month").parquet(f"{path}_sessions")
    published = spark.read.parquet(f"{path}_sessions")
    pruned = re.findall(r"PartitionFilters: \[(.*?)\], ", plan(mart(published, days=days)))
    assert pruned and all("1996-02" in f and "1996-03" in f for f in pruned)

    whole = mart(raw).filter(F.col("event_date").between(*days)).collect()
    assert len(whole) == 20
    for ranged in (mart(raw, days=days), mart(published, days=days)):
        assert sorted(map(str, ranged.collect())) == sorted(map(str, whole))


def test_other_time_zones_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            order_events(spark, SF)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured.rstrip("/")


def test_shuffle_partitions():
    assert shuffle_partitions(10 << 40, 1000) == 81920
    assert shuffle_partitions(1, 8) == 8
