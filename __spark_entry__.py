
from __future__ import annotations

import functools
import os
import sys
import warnings
from collections.abc import Callable
from datetime import date, datetime, timedelta

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracles
from footfall.operators import audience, cohort, funnel, history, kpi, sessions, sketches
from footfall.plans import charts, dashboard, marts
from footfall.settings import fresh_dir
from footfall.sources import adapters, events, validation

# The training-data operators are optional: they may be absent, or packages that only they need.
OPTIONAL = ("xxhash", "zstandard", "tokenizers", "sentencepiece", "public_tokenizers")

try:
    import corpus_pipeline
    from footfall.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "footfall.llm", *OPTIONAL):
        raise
    if missing.name in OPTIONAL:
        warnings.warn(f"no training-data operators: {missing.name} is not installed", stacklevel=1)
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Session funnel with drop-off and time to buy."""
    return queries()["funnel_overall"](spark, SMOKE_DIR)


def _plain(df: DataFrame) -> DataFrame:
    """Exact DECIMAL results as DOUBLE, the type the comparison reads on both sides."""
    return df.withColumns(
        {
            f.name: F.col(f.name).cast("double")
            for f in df.schema
            if isinstance(f.dataType, T.DecimalType)
        }
    )


def _read_events_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "events_by_month")
    events.write_events(adapters.order_events(spark, sf_dir), path)
    return events.read_events(
        spark, path, datetime(1996, 3, 15), datetime(1998, 7, 2), fmt="parquet"
    )


def _read_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "events_by_time")
    events.write_events(adapters.order_events(spark, sf_dir), path, clustered=True)
    return events.read_events(
        spark, path, datetime(1996, 3, 15), datetime(1996, 3, 19), fmt="parquet"
    )


PAUSES = {"cart": timedelta(hours=2), "purchase": timedelta(minutes=5)}


def _sample(kind: str):
    """The sample files, read back in one of their formats."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_dir(spark, "sample")
        events.write_sample(
            adapters.shop_events(spark, sf_dir), f"{path}/events.csv", f"{path}/events.parquet"
        )
        return events.read_events(spark, f"{path}/events.{kind}")

    return run


def _mart(view: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        marts.create_views(adapters.shop_events(spark, sf_dir))
        return spark.table(view)

    return run


RECENT = dashboard.last_days(date(2024, 1, 25))


DATABASE = "footfall_published"


def _published(read: Callable[[SparkSession, str], DataFrame], names: tuple | None = None):
    """The raw table, replaced once, and marts as tables of a database of their own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not spark.catalog.databaseExists(DATABASE):
            spark.sql(f"CREATE DATABASE {DATABASE} LOCATION '{fresh_dir(spark, DATABASE)}'")
        clicks = adapters.shop_events(spark, sf_dir)
        raw = f"{DATABASE}.raw_events"
        marts.publish_raw(spark, clicks.filter(F.col("event_type") == "view"), raw)
        marts.publish_raw(spark, clicks, raw)
        marts.publish_tables(spark, spark.table(raw), DATABASE, names)
        return read(spark, DATABASE)

    return run


def _published_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily metrics of a folder's last whole version; a later one failed half-way."""
    folder = fresh_dir(spark, "published")
    clicks = adapters.shop_events(spark, sf_dir)
    marts.publish_folder(spark, clicks, folder)
    change = marts.Versions(spark, folder).change()
    change.write("v_kpi_daily", kpi.kpi_daily(clicks.filter(F.col("event_type") == "view")))
    return _plain(marts.published(spark, folder, "v_kpi_daily"))


def _described(spark: SparkSession, database: str) -> DataFrame:
    """Name, description and rows of every published table."""
    tables = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    each = (
        spark.table(f"{database}.{t.name}").agg(
            F.lit(t.name).alias("name"),
            F.lit(t.description).alias("description"),
            F.count("*").alias("n_rows"),
        )
        for t in tables
    )
    return functools.reduce(DataFrame.unionByName, each)


def _recent(build):
    """A mart of thirty days on the published session table, which is cut by month."""

    def read(spark: SparkSession, database: str) -> DataFrame:
        return build(spark.table(f"{database}.{marts.SESSIONIZED}"), days=RECENT)

    return _published(read, names=())


def _by_parts(read: Callable[[history.SessionHistory], DataFrame]):
    """Sessions added in four steps: some days, later ones, those between, late events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grown = history.SessionHistory(spark, fresh_dir(spark, "history"), period="day")
        clicks = adapters.shop_events(spark, sf_dir)
        of_day, late = F.dayofmonth("event_time"), F.col("product_id") % 50 == 0
        punctual = clicks.filter(~late)
        grown.add(punctual.filter(of_day <= 8))
        grown.add(punctual.filter(of_day > 15))
        grown.add(punctual.filter((of_day > 8) & (of_day <= 15)))
        grown.add(clicks.filter(late))
        return read(grown)

    return run


def _audience(read: Callable[[audience.Audience], DataFrame]):
    """Sets of users, the second half of the days added first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sets = audience.Audience(spark, fresh_dir(spark, "audience"))
        clicks = adapters.shop_events(spark, sf_dir)
        sets.add(clicks.filter(F.dayofmonth("event_time") > 15))
        sets.add(clicks.filter(F.dayofmonth("event_time") <= 15))
        return read(sets)

    return run


def _mixed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers differ, some with lines of too many fields, loaded as one folder."""
    folder = adapters.mixed_csv(spark, sf_dir, fresh_dir(spark, "mixed_csv"))
    valid, rejected = validation.validate_events(events.load_events(spark, folder, "csv"))
    kept = ("product_id", "user_id", "price", "event_type")
    return valid.select(*kept, F.lit("").alias("failed_rules")).unionByName(
        rejected.select(
            F.col("product_id").cast("long").alias("product_id"),
            F.col("user_id").cast("long").alias("user_id"),
            F.col("price").cast("decimal(10,2)").alias("price"),
            "event_type",
            F.concat_ws(",", "failed_rules").alias("failed_rules"),
        )
    )


def _rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "valid_events")
    counts = validation.write_valid(adapters.unchecked_events(spark, sf_dir), path)
    counts["rows_written"] = events.load_events(spark, path, "parquet").count()
    return spark.createDataFrame(list(counts.items()), "rule string, n long")


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = validation.validate_events(adapters.unchecked_events(spark, sf_dir))
    return rejected.withColumn("failed_rules", F.concat_ws(",", "failed_rules"))


def _filtered(summary: DataFrame) -> DataFrame:
    chosen = dashboard.among(summary, "top_category", ["economy", "small", "uncategorized"])
    return dashboard.among(chosen, "brand", ["unknown", *(f"Brand#{i}" for i in range(1, 6))])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(source: Callable[..., DataFrame], build: Callable[[DataFrame], DataFrame], **kw):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain(build(source(spark, sf_dir, **kw)))

        return run

    def shop(build):
        return of(adapters.shop_events, build)

    def clicks(build):
        return of(adapters.shop_events, build, products=False)

    def orders(build):
        return of(adapters.order_events, build)

    def job(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain(build(spark, sf_dir))

        return run

    def steps(df, **kw):
        return sessions.session_steps(df, **kw)

    daily, summary = kpi.kpi_daily, funnel.funnel_summary

    def monthly(df):
        return cohort.cohort_retention(df, "M")

    def written(build, name):
        """The flat table is written once; its matrix reads it twice."""

        def run(df):
            path, flat = fresh_dir(df.sparkSession, name), build(df)
            flat.write.parquet(path)
            return df.sparkSession.read.schema(flat.schema).parquet(path)

        return run

    flat_month = written(lambda df: cohort.flat_retention(df, "M"), "flat_month")
    flat_week = written(charts.weekly_cohort_rates, "flat_week")
    weekly = written(cohort.flat_retention_weekly, "weekly")

    def cells(matrix, value):
        """The matrix as rows, in columns that do not depend on the data."""
        found = cohort.matrix_cells(matrix, "cohort_group", "cohort_index", value)
        return found.withColumn("cohort_index", F.col("cohort_index").cast("long"))

    def gaps(build, **kw):
        return of(adapters.shop_events, build, gaps=True, **kw)

    corpus = {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}
    return corpus | {
        "sessionize": shop(sessions.sessionize),
        "session_steps": clicks(steps),
        "session_summary": clicks(lambda df: sessions.session_summary(df, PAUSES)),
        "session_funnel": clicks(lambda df: funnel.session_funnel(steps(df))),
        "funnel_step_counts": clicks(lambda df: funnel.funnel_step_counts(steps(df))),
        "funnel_overall": clicks(lambda df: funnel.funnel_overall(steps(df))),
        "funnel_per_instant": clicks(
            lambda df: funnel.funnel_overall(steps(df, per_instant=True))
        ),
        "kpi_daily": clicks(daily),
        "funnel_summary": shop(summary),
        "cohort_weekly": clicks(
            lambda df: cohort.cohort_retention_weekly(sessions.sessionize(df))
        ),
        "cohort_weekly_orders": orders(
            lambda df: cohort.cohort_retention_weekly(sessions.sessionize(df))
        ),
        "cohort_day": clicks(lambda df: cohort.cohort_retention(df, "D")),
        "cohort_day_orders": orders(lambda df: cohort.cohort_retention(df, "D")),
        "cohort_week": orders(lambda df: cohort.cohort_retention(df, "W")),
        "cohort_month": orders(monthly),
        "cohort_buyers": clicks(lambda df: cohort.cohort_retention(df, "D", "purchase")),
        "cohort_events": shop(lambda df: cohort.cohort_events(df, "D")),
        "cohort_counts_matrix": orders(
            lambda df: cells(
                cohort.cohort_matrix(flat_month(df), "active_users"), "active_users"
            )
        ),
        "cohort_rate_matrix": orders(
            lambda df: cells(
                cohort.cohort_matrix(flat_month(df), "retention_rate"), "retention_rate"
            )
        ),
        "cohort_chart": orders(
            lambda df: cells(charts.weekly_cohort_chart(flat_week(df)), "retention_rate")
        ),
        "cohort_heatmap_feed": orders(
            lambda df: charts.heatmap_feed(monthly(df))
        ),
        "funnel_users": clicks(funnel.funnel_users),
        "funnel_users_rates": clicks(
            lambda df: funnel.funnel_users_rates(funnel.funnel_users(df))
        ),
        "funnel_stages": clicks(lambda df: charts.funnel_stages(funnel.funnel_users(df))),
        "kpi_trends": clicks(kpi.kpi_trends),
        "kpi_cards": clicks(lambda df: dashboard.kpi_cards(daily(df))),
        "funnel_totals": shop(lambda df: dashboard.funnel_totals(summary(df))),
        "dropoff_by_category": shop(lambda df: dashboard.dropoff_by_category(summary(df))),
        "cohort_pivot": orders(
            lambda df: cohort.matrix_cells(
                dashboard.cohort_pivot(weekly(df)), "cohort_week", "week", "mean_rate_pct"
            )
        ),
        "treemap": shop(lambda df: dashboard.treemap(summary(df))),
        "treemap_rollup": shop(lambda df: dashboard.treemap_rollup(summary(df))),
        "category_revenue": shop(lambda df: dashboard.category_revenue(df, summary(df))),
        "brand_matrix": shop(dashboard.brand_matrix),
        "dashboard_filtered": shop(lambda df: _filtered(summary(df, days=RECENT))),
        "valid_events": of(
            adapters.unchecked_events, lambda df: validation.validate_events(df)[0]
        ),
        "rejected_events": job(_rejected),
        "csv_mixed_headers": job(_mixed_csv),
        "rule_counts": job(_rule_counts),
        "sessions_by_parts": job(_by_parts(history.SessionHistory.sessionized)),
        "session_steps_by_parts": job(_by_parts(history.SessionHistory.session_steps)),
        "users_of_range": job(_audience(lambda sets: sets.of_range(*RECENT))),
        "users_rolling": job(_audience(lambda sets: sets.rolling(*RECENT))),
        "funnel_levels": shop(lambda df: sketches.by_levels(sketches.funnel_sketches(df))),
        "time_to_buy_by_cell": shop(lambda df: funnel.time_to_buy(df, ["top_category", "brand"])),
        "time_to_buy_by_day": gaps(
            lambda df: funnel.time_to_buy(df, ["event_date"]), products=False
        ),
        "kpi_daily_gaps": gaps(daily, products=False),
        "funnel_summary_gaps": gaps(summary),
        "funnel_step_counts_gaps": gaps(
            lambda df: funnel.funnel_step_counts(steps(df)), products=False
        ),
        "funnel_users_gaps": gaps(funnel.funnel_users, products=False),
        "brand_matrix_gaps": gaps(dashboard.brand_matrix),
        "cohort_buyers_week": clicks(lambda df: cohort.cohort_retention(df, "W", "purchase")),
        "cohort_buyers_month": clicks(lambda df: cohort.cohort_retention(df, "M", "purchase")),
        "mart_funnel_summary": job(_mart("v_funnel_summary")),
        "mart_cohort_retention": job(_mart("v_cohort_retention")),
        "mart_sessionized": job(_mart("v_events_sessionized")),
        "cohort_events_week": orders(lambda df: cohort.cohort_events(df, "W")),
        "cohort_events_month": orders(lambda df: cohort.cohort_events(df, "M", "purchase")),
        "published_tables": job(_published(_described)),
        "published_folder": job(_published_folder),
        "published_recent_kpi": job(_recent(daily)),
        "published_recent_summary": job(_recent(summary)),
        "sample_parquet": job(_sample("parquet")),
        "read_events_range": job(_read_events_range),
        "read_days_clustered": job(_read_clustered),
        "csv_roundtrip": job(_sample("csv")),
        "mart_views": job(_mart("v_kpi_daily")),
    }


def oracle_sql() -> dict[str, str]:
    corpus = llm.oracle_sql() if llm else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        corpus["pipeline"] = corpus_pipeline.ORACLE_SQL
    return corpus | oracles.oracle_sql()
