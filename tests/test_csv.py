"""CSV files whose headers differ, malformed lines, and rules counted on the way."""

import gzip
from collections import Counter

import pytest

from footfall.schema import RAW_COLUMNS
from footfall.sources.csv_files import MALFORMED, read_csv
from footfall.sources.events import load_events, read_events
from footfall.sources.validation import rules, validate_events, write_valid

HEAD = "event_time,event_type,product_id,price,user_id"
GOOD = "2024-01-01 00:00:00,view,5,1.00,999"


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            data = text.encode()
            if name.endswith("gz"):
                (tmp_path / f"{name[:-2]}.csv.gz").write_bytes(gzip.compress(data))
            else:
                (tmp_path / f"{name}.csv").write_bytes(data)
        return f"file://{tmp_path}"

    return write


def test_columns_in_another_order(spark, folder):
    path = folder(
        a=f"{HEAD}\n{GOOD}\n",
        b="user_id,event_type,price,event_time,product_id,brand\n999,view,1.00,2024-01-01 00:00:00,5,x\n",
        cgz=f"﻿{HEAD}\r\n{GOOD}\r\n",
        empty="",
        header_alone=HEAD,
    )
    valid, rejected = validate_events(load_events(spark, path, "csv"))
    assert [(r.product_id, r.user_id) for r in valid.collect()] == [(5, 999)] * 3
    assert sorted(r.brand or "" for r in valid.collect()) == ["", "", "x"]
    assert rejected.count() == 0
    assert read_events(spark, path, fmt="csv").columns == RAW_COLUMNS


def test_wrong_numbers_of_fields_are_rejected(spark, folder):
    lines = [GOOD, f"{GOOD},more,fields", "2024-01-01 00:00:00,view", '"a, quoted",view,1,2,3', GOOD]
    path = folder(a="\n".join([HEAD, *lines, ""]))
    valid, rejected = validate_events(load_events(spark, path, "csv"))
    assert valid.count() == 2
    got = {r[MALFORMED]: list(r.failed_rules) for r in rejected.collect()}
    assert got == {lines[1]: ["csv_fields"], lines[2]: ["csv_fields"], None: ["event_time_type"]}
    # reading on without looking at them is an error, whatever columns are asked for
    with pytest.raises(Exception, match="malformed CSV line: .*more,fields"):
        read_events(spark, path, fmt="csv").groupBy("event_type").count().collect()


def test_a_lost_column_is_an_error(spark, folder):
    path = folder(a="event_time,event_type,product_id,price\n2024-01-01,view,5,1\n")
    with pytest.raises(ValueError, match="lack required columns: user_id"):
        validate_events(load_events(spark, path, "csv"))
    with pytest.raises(ValueError, match="names a column twice"):
        read_csv(spark, folder(a="x,x\n1,2\n"))
    with pytest.raises(ValueError, match="no CSV file with a header"):
        read_csv(spark, folder(a=""))


def test_only_the_columns_asked_for_are_read(spark, folder):
    df = read_csv(spark, folder(a=f"{HEAD}\n{GOOD}\n"))
    plan = df.select("price")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:string>" in plan


def test_rules_are_counted_on_the_way(spark, folder, tmp_path):
    lines = [GOOD] * 3 + [f"{GOOD},x", "yesterday,view,5,-1,999", ",view,5,1,x"]
    path = folder(a="\n".join([HEAD, *lines]))
    loaded = load_events(spark, path, "csv")
    counts = write_valid(loaded, f"file://{tmp_path}/out")
    _, rejected = validate_events(loaded)
    want = Counter(rule for r in rejected.collect() for rule in r.failed_rules)
    assert counts == {"rows_read": 6, "csv_fields": 1, **{r: want[r] for r in rules()}}
    assert sum(want.values()) == 5
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
