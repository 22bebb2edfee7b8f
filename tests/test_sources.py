import os
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import TESTDATA
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from footfall.schema import RAW_COLUMNS, RAW_EVENTS, conform
from footfall.settings import shared_dir
from footfall.sources.adapters import order_events
from footfall.sources.events import load_events, read_events, write_events, write_sample
from footfall.sources.validation import validate_events

UUID = "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9"
GOOD = dict(
    event_time="2024-01-01 00:00:00", event_type="view", product_id="1", category_id="2",
    category_code="a.b", brand="b", price="9.99", user_id="3", user_session=UUID,
)


@pytest.fixture(scope="module")
def loaded(spark):
    def make(*rows):
        schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
        values = [tuple({**GOOD, **r}[c] for c in RAW_COLUMNS) for r in rows]
        return spark.createDataFrame(values, schema)

    return make


def failed(loaded, **row):
    _, rejected = validate_events(loaded(row))
    return [r.failed_rules for r in rejected.collect()]


def test_good_row_is_typed(loaded):
    valid, rejected = validate_events(loaded({}))
    assert rejected.count() == 0
    assert [f.dataType for f in valid.schema] == [f.dataType for f in RAW_EVENTS]
    row = valid.first()
    assert (row.event_time, row.price, row.user_id) == (datetime(2024, 1, 1), Decimal("9.99"), 3)


@pytest.mark.parametrize(
    "row, rules",
    [
        (dict(user_id=None), ["user_id_not_null"]),
        (dict(event_time=None), ["event_time_not_null"]),
        (dict(event_time="yesterday-ish"), ["event_time_type"]),
        (dict(product_id="x"), ["product_id_type"]),
        (dict(price="-1"), ["price_not_negative"]),
        (dict(price="123456789.00"), ["price_type"]),
        (dict(event_type="x" * 31), ["event_type_length"]),
        (dict(brand="x" * 256, category_code="x" * 256), ["category_code_length", "brand_length"]),
        (dict(user_session="not-a-uuid"), ["user_session_uuid"]),
        (dict(user_session="{" + UUID), ["user_session_uuid"]),
        (dict(user_session=UUID + "\n"), ["user_session_uuid"]),
        (dict(user_id=None, price="-1"), ["user_id_not_null", "price_not_negative"]),
    ],
    ids=lambda v: ",".join(v) if isinstance(v, list) else "",
)
def test_bad_rows(loaded, row, rules):
    assert failed(loaded, **row) == [rules]


def test_nullable_columns_may_be_null(loaded):
    row = dict(category_id=None, category_code=None, brand=None, price=None, user_session=None)
    valid, _ = validate_events(loaded(row))
    assert tuple(valid.first())[3:7] == (None,) * 4 and valid.first().user_session is None


@pytest.mark.parametrize("spelling", [UUID.upper(), UUID.replace("-", ""), "{" + UUID + "}"])
def test_uuid_spellings_become_one(loaded, spelling):
    valid, _ = validate_events(loaded(dict(user_session=spelling)))
    assert valid.first().user_session == UUID


def test_stored_values(loaded):
    rows = [*(dict(price=p) for p in ("0.125", "99999999.99", "-0.004"))]
    valid, _ = validate_events(loaded(*rows, dict(event_type="x" * 30 + "  ")))
    out = valid.collect()
    assert [r.price for r in out[:3]] == [Decimal("0.13"), Decimal("99999999.99"), 0]
    assert out[3].event_type == "x" * 30


def test_valid_and_rejected_partition_the_rows(loaded):
    rows = [{}, dict(price="-1"), dict(user_id=None), dict(brand=None)]
    valid, rejected = validate_events(loaded(*rows))
    assert (valid.count(), rejected.count()) == (2, 2)


def test_conform(spark, make_events):
    partial = spark.createDataFrame(
        [("2024-01-01 00:00:00", 1, 9.995, "view", 2)],
        "event_time string, user_id int, price double, event_type string, product_id int",
    )
    out = conform(partial)
    assert out.columns == RAW_COLUMNS
    assert (out.first().event_time, out.first().price) == (datetime(2024, 1, 1), Decimal("10.00"))
    with pytest.raises(ValueError, match="user_id"):
        conform(partial.drop("user_id"))


def test_formats(spark, make_events, tmp_path):
    events = make_events(
        dict(event_time="2024-01-01 00:00:00.123456", brand="a,\"b", price="1.5"),
        dict(event_time="2024-01-02", category_code="x.y", user_session=UUID),
    )
    csv, parquet = str(tmp_path / "e.csv"), str(tmp_path / "e.parquet")
    write_sample(events, csv, parquet)
    for path in (csv, parquet):
        back = read_events(spark, path)
        assert [f.dataType for f in back.schema] == [f.dataType for f in RAW_EVENTS]
        assert sorted(map(str, back.collect())) == sorted(map(str, events.collect()))
    # writing again replaces
    write_sample(events, csv, parquet)
    assert read_events(spark, csv).count() == 2


def test_files_with_zoneless_times_and_float_prices(spark, tmp_path):
    """Data frame libraries write naive times and float prices."""
    path = str(tmp_path / "naive.parquet")
    table = pa.table(
        {
            "event_time": pa.array([datetime(2024, 1, d, 12) for d in (1, 2, 3)], pa.timestamp("us")),
            "event_type": ["view", "cart", "purchase"],
            "product_id": [1, 1, 1],
            "price": [1.005, 2.0, None],
            "user_id": [1, 1, 1],
            "user_session": [UUID] * 3,
        }
    )
    pq.write_table(table, path)
    whole = read_events(spark, path)
    assert [f.dataType for f in whole.schema] == [f.dataType for f in RAW_EVENTS]
    assert sorted(r.event_time.day for r in whole.collect()) == [1, 2, 3]
    part = read_events(spark, path, datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert [r.event_time for r in part.collect()] == [datetime(2024, 1, 2, 12)]
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_time" in scan.split("PushedFilters: [")[1]


@pytest.mark.parametrize("path", ["events.json", "events.PARQUET", "events"])
def test_unsupported_format(spark, path):
    with pytest.raises(ValueError, match="unsupported file format"):
        load_events(spark, path)


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_events(spark, str(tmp_path / "none.parquet"))


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months") / "raw_events")
    write_events(order_events(spark, f"{TESTDATA}/sf0.001"), path)
    return path


def test_one_folder_per_month(spark, by_month):
    folders = {d for d in os.listdir(by_month) if d.startswith("event_month=")}
    assert "event_month=1995-01" in folders and len(folders) == 80
    assert read_events(spark, by_month, fmt="parquet").count() == 1500


def test_range_read_prunes_folders_and_pushes_the_time(spark, by_month):
    df = read_events(spark, by_month, datetime(1996, 2, 15), datetime(1996, 4, 1), fmt="parquet")
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_time" in scan.split("PushedFilters: [")[1].split("]")[0]
    months = {f.split("event_month=")[1][:7] for f in df.inputFiles()}
    read = df.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("event_month=")[1][:7] for r in read} == {"1996-02", "1996-03"} <= months
    lower, upper = datetime(1996, 2, 15), datetime(1996, 4, 1)
    whole = read_events(spark, by_month, fmt="parquet")
    time = F.col("event_time")
    assert df.count() == whole.filter((time >= lower) & (time < upper)).count()


def test_range_takes_zoned_times(spark, by_month):
    zone = timezone(timedelta(hours=3))
    zoned = read_events(spark, by_month, datetime(1996, 3, 1, 3, tzinfo=zone), fmt="parquet")
    naive = read_events(spark, by_month, datetime(1996, 3, 1), fmt="parquet")
    assert zoned.count() == naive.count()


def test_backfill_replaces_only_its_months(spark, make_events, tmp_path):
    path = str(tmp_path / "raw")
    write_events(make_events(dict(event_time="2024-01-05"), dict(event_time="2024-02-05")), path)
    write_events(make_events(*(dict(event_time=f"2024-02-0{i}") for i in (1, 2, 3))), path)
    months = {
        r.m: r.n
        for r in read_events(spark, path, fmt="parquet")
        .groupBy(F.date_format("event_time", "yyyy-MM").alias("m"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    assert months == {"2024-01": 1, "2024-02": 3}


def test_a_large_month_gets_several_writers(spark, tmp_path):
    """A month with most of the rows is split over files, not written by one task."""
    conf = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.shuffle.partitions": "200",
    }
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        path = str(tmp_path / "skewed")
        events = order_events(spark, f"{TESTDATA}/sf0.01").withColumn(
            "event_time",
            F.when(F.col("product_id") % 10 > 0, F.lit("2024-01-15").cast("timestamp")).otherwise(
                F.col("event_time")
            ),
        )
        write_events(events.repartition(8), path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

    def files(month):
        return sum(f.endswith("parquet") for f in os.listdir(f"{path}/event_month={month}"))

    assert files("2024-01") > 1 and files("1995-02") == 1
    assert read_events(spark, path, fmt="parquet").count() == 15000


def test_clustered_files_hold_stretches_of_time(spark, make_events, tmp_path):
    """A hot month, a third of it one instant: many writers, and a day skips most rows."""
    hot = datetime(2024, 1, 15, 12)
    times = [datetime(2024, 1, 1) + timedelta(minutes=7 * i) for i in range(6000)]
    rows = [dict(event_time=t, product_id=i) for i, t in enumerate(times)]
    rows += [dict(event_time=hot, product_id=10_000 + i) for i in range(3000)]
    events = make_events(*rows)
    path = f"file://{tmp_path}/clustered"
    # so few rows would be one partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_events(events, path, clustered=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "clustered" / "event_month=2024-01").glob("*.parquet"))
    assert len(files) > 2
    spans = []
    for file in files:
        column = pq.read_table(file, columns=["event_time"])["event_time"].to_pylist()
        assert column == sorted(column)
        spans.append((column[0], column[-1]))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sum(a <= hot.replace(tzinfo=a.tzinfo) <= b for a, b in spans) > 1

    def scanned(start, end):
        read = read_events(spark, path, start, end, fmt="parquet")
        found = read.collect()
        leaf = read._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(found), leaf.metrics().apply("numOutputRows").value()

    n, rows_read = scanned(datetime(2024, 1, 3), datetime(2024, 1, 4))
    _, of_month = scanned(datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert n == 206 and rows_read < of_month / 2
    whole = read_events(spark, path, fmt="parquet")
    assert sorted(r.product_id for r in whole.collect()) == sorted(r["product_id"] for r in rows)


@pytest.mark.parametrize(
    "conf, master, want",
    [
        ({"spark.checkpoint.dir": "hdfs:///shared/"}, "yarn", "hdfs:///shared"),
        ({"spark.sql.warehouse.dir": "hdfs:///tables"}, "yarn", "hdfs:///tables/_work"),
        ({"spark.sql.warehouse.dir": "file:/home/me/tables"}, "local[2]", "file:/home/me/tables/_work"),
        ({"spark.sql.warehouse.dir": "file:/home/me/tables"}, "yarn", None),
    ],
)
def test_shared_folder_is_never_one_of_the_driver_alone(conf, master, want):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
        sparkContext=SimpleNamespace(master=master),
    )
    if want:
        assert shared_dir(session) == want
    else:
        with pytest.raises(ValueError, match="set spark.checkpoint.dir"):
            shared_dir(session)
