"""The named marts that dashboards read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from footfall.operators.cohort import cohort_retention_weekly
from footfall.operators.funnel import funnel_summary
from footfall.operators.kpi import kpi_daily
from footfall.operators.sessions import sessionize
from footfall.sources.events import MONTH, by_month
from footfall.sources.versions import Versions

SESSIONIZED = "v_events_sessionized"

# mart -> (function of raw or sessionized events, description)
MARTS = {
    "v_kpi_daily": (
        kpi_daily,
        "Daily active users, sessions, orders, revenue, AOV, ARPU and conversion",
    ),
    "v_funnel_summary": (
        funnel_summary,
        "Conversion funnel by day, top category and brand",
    ),
    "v_cohort_retention": (
        cohort_retention_weekly,
        "Weekly cohort retention, one row per cohort and elapsed week",
    ),
}

SESSIONIZED_COMMENT = "Events with sessions rebuilt from 30-minute inactivity gaps"

RAW_COMMENTS = {
    "event_time": "UTC time of the event",
    "event_type": "view, cart, remove_from_cart or purchase",
    "user_id": "User identifier",
    "user_session": "Session UUID of the frontend, may be missing",
}


def create_views(events: DataFrame) -> dict[str, DataFrame]:
    """Register the sessionized events and the marts as temporary views; nothing runs.

    Each view is a plan of its own over the raw events; ``publish_tables`` shares the work.
    """
    frames = {SESSIONIZED: sessionize(events)}
    frames |= {name: build(events) for name, (build, _) in MARTS.items()}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return frames


class Publication:
    """New tables behind a database's names, shown together once all are written.

    The tables are written to a database of their own version; only then the names, which are
    views, are turned to them. A job that fails half-way leaves every name on its old
    table. The version before stays for those still reading it; older ones are dropped.
    """

    def __init__(self, spark: SparkSession, database: str, kind: str):
        self.spark, self.database, self.prefix = spark, database, f"{database}__{kind}_"
        self.names: dict[str, str] = {}

    def _versions(self) -> list[str]:
        found = self.spark.catalog.listDatabases(f"{self.prefix}*")
        return sorted(d.name for d in found)

    def __enter__(self) -> Publication:
        last = max((int(v.removeprefix(self.prefix)) for v in self._versions()), default=0)
        self.version = f"{self.prefix}{last + 1:06d}"
        folder = self.spark.catalog.getDatabase(self.database).locationUri.rstrip("/")
        self.spark.sql(f"CREATE DATABASE {self.version} LOCATION '{folder}/_{self.version}'")
        return self

    def save(
        self, name: str, frame: DataFrame, comment: str, partitioned: bool = False
    ) -> DataFrame:
        """Write a table; what is read back."""
        writer = frame.write.partitionBy(MONTH) if partitioned else frame.write
        writer.saveAsTable(f"{self.version}.{name}")
        self.names[name] = comment
        return self.spark.table(f"{self.version}.{name}")

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.spark.sql(f"DROP DATABASE {self.version} CASCADE")
            return
        listed = self.spark.catalog.listTables(self.database)
        tables = {t.name for t in listed if t.tableType not in ("VIEW", "TEMPORARY")}
        for name, comment in self.names.items():
            if name in tables:  # not a name of an earlier publication
                self.spark.sql(f"DROP TABLE {self.database}.{name}")
            columns = ", ".join(
                f"`{c}` COMMENT '{RAW_COMMENTS[c]}'" if c in RAW_COMMENTS else f"`{c}`"
                for c in self.spark.table(f"{self.version}.{name}").columns
            )
            self.spark.sql(
                f"CREATE OR REPLACE VIEW {self.database}.{name} ({columns}) "
                f"COMMENT '{comment}' AS SELECT * FROM {self.version}.{name}"
            )
        for old in self._versions()[:-2]:
            self.spark.sql(f"DROP DATABASE {old} CASCADE")


def publish_tables(
    spark: SparkSession,
    events: DataFrame,
    database: str = "default",
    names: Iterable[str] | None = None,
) -> None:
    """Publish the sessionized events and the marts, or those named, with descriptions.

    The marts read the written session table, so sessions are computed once and a lost
    executor never costs more than one mart's own stages.
    """
    with Publication(spark, database, "marts") as new:
        sessionized = new.save(
            SESSIONIZED, by_month(sessionize(events)), SESSIONIZED_COMMENT, partitioned=True
        )
        for name in MARTS if names is None else names:
            build, comment = MARTS[name]
            new.save(name, build(sessionized), comment)


def publish_raw(spark: SparkSession, events: DataFrame, table: str) -> None:
    """Publish the raw event table, one partition per month, with its columns described."""
    database, _, name = table.rpartition(".")
    with Publication(spark, database or "default", name) as new:
        new.save(name, by_month(events), "Clickstream events of the shop", partitioned=True)


def publish_folder(spark: SparkSession, events: DataFrame, folder: str) -> int:
    """The sessionized events and the marts as one version of a folder; its number.

    All of them are seen from one moment on, by the one manifest that names them; see
    ``sources.versions``.
    """
    versions = Versions(spark, folder)
    with versions.change() as change:
        change.write(SESSIONIZED, by_month(sessionize(events)), by=MONTH)
        for name, (build, _) in MARTS.items():
            change.write(name, build(change.read(SESSIONIZED)))
    return change.manifest["number"]


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the latest version of a folder."""
    return Versions(spark, folder).read(name)
