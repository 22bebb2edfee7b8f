"""Reading and writing raw event files."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from footfall.schema import conform, with_event_time
from footfall.sources.csv_files import read_csv, refuse_malformed

MONTH = "event_month"


def load_events(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Lazy scan with the columns and types of the file; CSV columns come as text.

    The format follows the (case-sensitive) extension unless ``fmt`` names it, as for a
    folder written by ``write_events``. No pass over the data infers types. For CSV see
    ``sources.csv_files``.
    """
    if fmt is None:
        fmt = next((e for e in ("parquet", "csv") if path.endswith(f".{e}")), None)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return read_csv(spark, path)
    raise ValueError(f"unsupported file format: {path} (supported: .parquet, .csv)")


def read_events(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    fmt: str | None = None,
    keep_month: bool = False,
) -> DataFrame:
    """Raw events in the declared schema, optionally of ``start <= event_time < end``.

    A malformed line of a CSV file is an error; ``load_events`` and ``validate_events`` set
    such lines aside instead. ``keep_month`` leaves the month column of a folder written by ``write_events`` in the
    result, after the declared ones, so that ``on_days`` prunes folders later.
    """
    loaded = with_event_time(refuse_malformed(load_events(spark, path, fmt)))
    loaded = in_range(loaded, start, end)
    return conform(loaded, extra=[MONTH] if keep_month else [])


def in_range(
    events: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Events of ``start <= event_time < end``.

    Where the events carry their month the range also becomes a range of months: Spark
    prunes folders by the partition column only, not by the time it derives from.
    """
    if MONTH in events.columns:
        events = events.filter(_month_range(start, end))
    # compared in the type of the file, so that the filter reaches the scan
    return events.filter(_time_range(start, end, events.schema["event_time"].dataType))


def on_days(events: DataFrame, days: tuple[date, date] | None) -> DataFrame:
    """Events from the first to the last of two UTC days, both included; all for None."""
    if days is None:
        return events
    first, last = (datetime.combine(d, time()) for d in days)
    return in_range(events, first, last + timedelta(days=1))


def _month_range(start: datetime | None, end: datetime | None) -> Column:
    month, kept = F.col(MONTH), F.lit(True)
    if start is not None:
        kept = kept & (month >= _utc(start).strftime("%Y-%m"))
    if end is not None:
        last = _utc(end) - timedelta(microseconds=1)
        kept = kept & (month <= last.strftime("%Y-%m"))
    return kept


def _time_range(start: datetime | None, end: datetime | None, time_type: DataType) -> Column:
    def moment(at: datetime) -> Column:
        return F.lit(_utc(at).isoformat(sep=" ")).cast(time_type)

    at, kept = F.col("event_time"), F.lit(True)
    if start is not None:
        kept = kept & (at >= moment(start))
    if end is not None:
        kept = kept & (at < moment(end))
    return kept


def _utc(moment: datetime) -> datetime:
    """Wall-clock time in UTC, the session zone by contract; naive times are taken as UTC."""
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def by_month(events: DataFrame) -> DataFrame:
    """Events with their month, shuffled for a write partitioned by it.

    The rebalance hint lets AQE split a large month over many writers and merge small
    ones, instead of one task per month.
    """
    return events.withColumn(MONTH, F.date_format("event_time", "yyyy-MM")).hint(
        "rebalance", MONTH
    )


def by_time(events: DataFrame) -> DataFrame:
    """Events with their month, in ranges of time, for files that hold a stretch of it each.

    A month of many rows is cut into several ranges and so has several writers. Rows of one
    instant are told apart by a hash, so that not even they end up with one writer.
    """
    rest = F.xxhash64(*(c for c in events.columns if c != "event_time"))
    month = F.date_format("event_time", "yyyy-MM")
    order = [MONTH, "event_time", "_rest"]
    ranged = events.withColumns({MONTH: month, "_rest": rest}).repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).drop("_rest")


def write_events(
    events: DataFrame, path: str, mode: str = "overwrite", clustered: bool = False
) -> None:
    """Write Parquet in one folder per month of ``event_time``.

    ``overwrite`` replaces only the months present in ``events``, which makes backfills
    safe to repeat. ``clustered`` costs a sort and lets a read of some days skip most of a
    month: each file and row group holds a short stretch of time. For that the session must
    write times as ``TIMESTAMP_MICROS`` (see ``settings``).
    """
    laid_out = by_time(events) if clustered else by_month(events)
    (
        laid_out.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )


def write_sample(events: DataFrame, csv_path: str, parquet_path: str) -> None:
    """Write the same events as CSV with a header and as Parquet."""
    to_csv = events.write.mode("overwrite").option("header", True)
    # the default text format stops at milliseconds
    to_csv.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(csv_path)
    events.write.mode("overwrite").parquet(parquet_path)
