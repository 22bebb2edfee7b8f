import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from footfall.schema import RAW_EVENTS
from footfall.settings import build_session

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        partitions=4,
        conf={
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": f"file:{tmp_path_factory.mktemp('shared')}/",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make_events(spark):
    """Raw events from dicts; unnamed columns get harmless defaults."""

    def make(*rows: dict):
        defaults = dict(
            event_type="view", product_id=1, category_id=None, category_code=None,
            brand=None, price=None, user_id=1, user_session=None,
        )
        full = []
        for row in rows:
            row = {**defaults, **row}
            if isinstance(row["event_time"], str):
                row["event_time"] = at(row["event_time"])
            if row["price"] is not None:
                row["price"] = Decimal(str(row["price"]))
            full.append(tuple(row[f.name] for f in RAW_EVENTS))
        return spark.createDataFrame(full, RAW_EVENTS)

    return make
