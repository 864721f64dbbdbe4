"""Materialised aggregates and the rules that keep them up to date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.operators.shared import pageviews
from visitmill.plans.clock import between, day_of, epoch, hour_of
from visitmill.schema import COUNTERS, scope


def _counters() -> list[Column]:
    seen, status = F.col("pageview_flag") == 1, F.col("status_code")

    def hits(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    classes = [hits((status >= 100 * n) & (status < 100 * (n + 1))).alias(f"s{n}xx") for n in (2, 3, 4, 5)]
    return [
        hits(seen).alias("pv"),
        F.sum(F.when(seen, F.col("bytes_sent")).otherwise(0)).cast("long").alias("traffic"),
        *classes,
        hits((status < 200) | (status >= 600)).alias("other"),
    ]


def agg_hourly(log: DataFrame) -> DataFrame:
    """Page views and traffic of page views; status counters of every row; per local hour."""
    return log.groupBy(*scope(log), hour_of("timestamp").alias("bucket")).agg(*_counters())


def agg_daily(log: DataFrame) -> DataFrame:
    return log.groupBy(*scope(log), day_of("timestamp").alias("day")).agg(*_counters())


def agg_hourly_ip(log: DataFrame) -> DataFrame:
    return pageviews(log).select(*scope(log), hour_of("timestamp").alias("bucket"), "ip").distinct()


def agg_daily_ip(log: DataFrame) -> DataFrame:
    return pageviews(log).select(*scope(log), day_of("timestamp").alias("day"), "ip").distinct()


def first_seen(log: DataFrame) -> DataFrame:
    return pageviews(log).groupBy(*scope(log), "ip").agg(F.min("timestamp").alias("first_ts"))


def agg_session_daily(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*scope(sessions), day_of("start_ts").alias("day")).agg(
        F.count("*").alias("sessions"))


def agg_entry_daily(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*scope(sessions), day_of("start_ts").alias("day"), "entry_url").agg(
        F.count("*").alias("count"))


# ---- merges: old table + delta -> new table ---------------------------------------------------------------------

def merge_additive(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of equal keys are added."""
    values = [c for c in old.columns if c not in keys]
    return old.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in values])


def merge_min(old: DataFrame, delta: DataFrame, keys: list[str], value: str = "first_ts") -> DataFrame:
    return old.unionByName(delta).groupBy(*keys).agg(F.min(value).alias(value))


def merge_set(old: DataFrame, delta: DataFrame) -> DataFrame:
    return old.unionByName(delta).distinct()


# ---- rebuilding one bucket --------------------------------------------------------------------------------------

def rebuild_hour(log: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Counters and visitor set of one hour, recomputed from the facts."""
    part = between(log, bucket, bucket + 3600)
    return agg_hourly(part), agg_hourly_ip(part)


def rebuild_day(log: DataFrame, day: dt.date, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    part = between(log, *_day_bounds(day, zone))
    return agg_daily(part), agg_daily_ip(part)


def rebuild_session_day(sessions: DataFrame, day: dt.date, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Session and entry counters of one day; a day without sessions gives no row."""
    part = between(sessions, *_day_bounds(day, zone), column="start_ts")
    return agg_session_daily(part), agg_entry_daily(part)


def _day_bounds(day: dt.date, zone: str) -> tuple[int, int]:
    """First second of the day and of the next one; a day with a clock change has 23 or 25 hours."""
    first, after = (dt.datetime.combine(d, dt.time()) for d in (day, day + dt.timedelta(days=1)))
    return epoch(first, zone), epoch(after, zone)


def put_bucket(table: DataFrame, fresh: DataFrame, column: str, value: Column) -> DataFrame:
    """The table with the rows of one bucket replaced."""
    return table.filter(F.col(column) != value).unionByName(fresh)


def counters_sum(df: DataFrame, condition: Column | None = None, prefix: str = "",
                 names: list[str] = COUNTERS) -> list[Column]:
    """Sums of counter columns, zero for no rows, over the rows that meet ``condition``."""
    def one(name: str) -> Column:
        value = F.col(name) if condition is None else F.when(condition, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(prefix + name)
    return [one(n) for n in names]
