"""A session table that grows by parts (months or days) without reading what it holds.

Inside a part sessions are numbered from 1, from the events of that part alone. What joins
the parts is one row per user and part - first and last time, number of sessions - and
one row per user with the last time and number of all: a part whose first event lies within the
gap after the user's last one goes on with that session, so the numbers of a part are its own
plus a base. Tables of the folder (see ``sources.versions``):

    rows      events with the number of their session when written     by part
    steps     first times of each step of each session, per part       by part
    numbers   user, first and last time, sessions, base                by part
    users     user, last time and number of sessions over all parts    whole

Later parts are appended with ``users`` alone. A part put between others shifts the numbers
behind it: their ``base`` is set anew from ``numbers``, the rows stay as they were written and
the difference is added when they are read. Either way no event of another part is read.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions.calendar import epoch_us, micros, slot_start
from footfall.operators.sessions import GAP, calculated_id, numbered_slots, step_times
from footfall.schema import RAW_COLUMNS, conform
from footfall.sources.versions import Change, Versions

# period -> (part column, its format in Spark and in Python)
PERIODS = {
    "month": ("event_month", "yyyy-MM", "%Y-%m"),
    "day": ("event_day", "yyyy-MM-dd", "%Y-%m-%d"),
}
ROWS, STEPS, NUMBERS, USERS = "rows", "steps", "numbers", "users"
NUMBER = "session_number"


class SessionHistory:
    """Sessions of all events added so far, equal to ``sessionize`` of all of them."""

    def __init__(
        self, spark: SparkSession, folder: str, gap: timedelta = GAP, period: str = "month"
    ):
        self.versions = Versions(spark, folder)
        self.gap = gap
        self.part, self.format, self.python_format = PERIODS[period]
        self.settings = {"gap_us": micros(gap), "period": period}

    # -- writing -------------------------------------------------------------------------

    def add(self, events: DataFrame) -> list[str]:
        """Add events to the parts they fall in; the names of these parts.

        Parts that hold events already are rewritten with both.
        """
        return self._put(events, replace=False)

    def replace(self, events: DataFrame) -> list[str]:
        """Make ``events`` the whole contents of the parts they fall in, as in a backfill."""
        return self._put(events, replace=True)

    def _put(self, events: DataFrame, replace: bool) -> list[str]:
        part = F.date_format("event_time", self.format)
        events = conform(events).withColumn(self.part, part)
        # at most as many rows as parts
        touched = sorted(r[0] for r in events.select(self.part).distinct().collect())
        if not touched:
            return []
        with self.versions.change() as change:
            if change.about.setdefault("settings", self.settings) != self.settings:
                raise ValueError(f"the history was written with {change.about['settings']}")
            if not replace and set(touched) & set(change.parts(ROWS)):
                held = change.read(ROWS, touched).select(*events.columns)
                events = events.unionByName(held)
            self._write_numbers(change, events, touched)
            self._write_rows(change, events, touched)
            self._write_steps(change, touched)
        return touched

    def _write_numbers(self, change: Change, events: DataFrame, touched: list[str]) -> None:
        known = change.parts(NUMBERS)
        before = [p for p in known if p < touched[0]]
        behind = [p for p in known if p > touched[0] and p not in touched]
        carried = self._carried(change, before, append=before == known)
        slots = numbered_slots(events.filter("user_id IS NOT NULL"), self.gap, [self.part])
        spans = slots.groupBy("user_id", self.part).agg(
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
            F.max("session_seq").alias("sessions"),
        )
        if carried is not None:
            # ahead of every part
            spans = spans.unionByName(
                carried.withColumn(self.part, F.lit("")), allowMissingColumns=True
            )
        if behind:
            columns = [*spans.columns, "written_base"]
            spans = spans.unionByName(
                change.read(NUMBERS, behind).select(*columns), allowMissingColumns=True
            )
        else:
            spans = spans.withColumn("written_base", F.lit(None).cast("long"))
        # a row per part and user: the window is as long as the history has parts
        in_order = Window.partitionBy("user_id").orderBy(self.part)
        idle = epoch_us(F.col("first_time")) - epoch_us(F.lag("last_time").over(in_order))
        goes_on = F.when(idle <= micros(self.gap), 1).otherwise(0)
        through = F.sum(F.col("sessions") - F.col("goes_on")).over(
            in_order.rowsBetween(Window.unboundedPreceding, 0)
        )
        numbers = (
            spans.withColumn("goes_on", goes_on)
            .withColumn("through", through)
            .filter(F.col(self.part) != "")
            .withColumn("base", F.col("through") - F.col("sessions"))
            .withColumn("written_base", F.coalesce("written_base", "base"))
            .drop("goes_on", "through")
        )
        change.write(NUMBERS, numbers.hint("rebalance", self.part), by=self.part)
        renumbered = set(change.about.get("renumbered", ())) - set(touched) | set(behind)
        if renumbered:
            change.about["renumbered"] = sorted(renumbered)
        new = change.read(NUMBERS, touched + behind).select(
            "user_id", "last_time", (F.col("base") + F.col("sessions")).alias("sessions")
        )
        known_users = new if carried is None else new.unionByName(carried)
        users = known_users.groupBy("user_id").agg(
            F.max("last_time").alias("last_time"), F.max("sessions").alias("sessions")
        )
        change.write(USERS, users)

    def _carried(self, change: Change, before: list[str], append: bool) -> DataFrame | None:
        """(user_id, last_time, sessions) of every user at the end of the parts ``before``."""
        if not before:
            return None
        if append:
            return change.read(USERS)
        return (
            change.read(NUMBERS, before)
            .groupBy("user_id")
            .agg(
                F.max("last_time").alias("last_time"),
                F.max(F.col("base") + F.col("sessions")).alias("sessions"),
            )
        )

    def _write_rows(self, change: Change, events: DataFrame, touched: list[str]) -> None:
        bases = change.read(NUMBERS, touched).select("user_id", self.part, "base")
        keys = ["user_id", self.part]
        numbers = (
            numbered_slots(events.filter("user_id IS NOT NULL"), self.gap, [self.part])
            .join(bases, keys)
            .select(*keys, "slot", (F.col("base") + F.col("session_seq")).alias(NUMBER))
        )
        slot = slot_start(F.col("event_time"), micros(self.gap))
        rows = events.withColumn("slot", slot).join(numbers, [*keys, "slot"], "left")
        rows = rows.select(*RAW_COLUMNS, NUMBER, self.part).hint("rebalance", self.part)
        change.write(ROWS, rows, by=self.part)

    def _write_steps(self, change: Change, touched: list[str]) -> None:
        number = F.when(F.col("user_session").isNull(), F.col(NUMBER)).alias(NUMBER)
        steps = (
            change.read(ROWS, touched)
            .groupBy("user_id", "user_session", number, self.part)
            .agg(*(f(c).alias(n) for n, (f, c) in step_times().items()))
        )
        change.write(STEPS, steps.hint("rebalance", self.part), by=self.part)

    # -- reading -------------------------------------------------------------------------

    def parts(self, first: date | None = None, last: date | None = None) -> list[str]:
        """Parts that hold events, from that of one day to that of another."""
        low, high = (d and d.strftime(self.python_format) for d in (first, last))
        known = self.versions.manifest()["tables"].get(ROWS, {"parts": {}})["parts"]
        return [p for p in sorted(known) if (not low or p >= low) and (not high or p <= high)]

    def _numbered(self, table: str, parts: list[str]) -> DataFrame:
        """Rows of a table with the present number of their session."""
        manifest = self.versions.manifest()
        rows = self.versions.read(table, parts, manifest)
        shifted = set(parts) & set(manifest["about"].get("renumbered", ()))
        if not shifted:
            return rows
        moved = (
            self.versions.read(NUMBERS, sorted(shifted), manifest)
            .select("user_id", self.part, (F.col("base") - F.col("written_base")).alias("by"))
            .filter("by <> 0")
        )
        return rows.join(moved, ["user_id", self.part], "left").withColumn(
            NUMBER, F.col(NUMBER) + F.coalesce("by", F.lit(0))
        )

    def _calculated(self) -> Column:
        return calculated_id(F.col(NUMBER))

    def sessionized(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The rows of ``sessionize`` of all events, or those from one day to another.

        Only the parts of these days are read.
        """
        rows = self._numbered(ROWS, self.parts(first, last))
        at = F.col("event_time")
        if first:
            rows = rows.filter(at >= F.lit(datetime(first.year, first.month, first.day)))
        if last:
            end = datetime(last.year, last.month, last.day) + timedelta(days=1)
            rows = rows.filter(at < F.lit(end))
        return rows.select(
            *(c for c in RAW_COLUMNS if c != "user_session"),
            F.col("user_session").alias("raw_user_session"),
            self._calculated().alias("calculated_session_id"),
            F.coalesce("user_session", self._calculated()).alias("effective_session_id"),
        )

    def session_steps(self) -> DataFrame:
        """The rows of ``session_steps`` of all events, put together from those of the parts."""
        steps = self._numbered(STEPS, self.parts())
        session = F.coalesce("user_session", self._calculated())
        return steps.groupBy("user_id", session.alias("effective_session_id")).agg(
            *(f(F.col(n)).alias(n) for n, (f, _) in step_times().items())
        )
