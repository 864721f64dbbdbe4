"""Dropping old rows and replacing a range, with the tables derived from them."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.operators import aggregates as agg
from visitmill.operators.overall import Tables
from visitmill.operators.sessions import session_state
from visitmill.plans.clock import between


def retention_cleanup(log: DataFrame, t: Tables, hourly: DataFrame, hourly_ip: DataFrame, cutoff: int,
                      zone: str = "UTC") -> dict[str, DataFrame]:
    """All tables without what is older than ``cutoff``.

    Whole buckets are dropped by a filter (partition pruning on stored tables); only the hour and the day that the
    cutoff falls into are counted again. First-seen is rebuilt, since a visitor's first kept visit may be later.
    ``zone`` must be the session time zone, in which the tables have their hours and days.
    """
    facts = between(log, cutoff)
    moment = dt.datetime.fromtimestamp(cutoff, ZoneInfo(zone))
    hour, day = cutoff - moment.minute * 60 - moment.second, moment.date()
    edge_hour, edge_hour_ip = agg.rebuild_hour(facts, hour)
    edge_day, edge_day_ip = agg.rebuild_day(facts, day, zone)
    sessions = t.sessions.filter(F.col("start_ts") >= cutoff)
    edge_sessions, edge_entries = agg.rebuild_session_day(sessions, day, zone)

    def later(table: DataFrame, column: str, edge, fresh: DataFrame) -> DataFrame:
        return table.filter(F.col(column) > edge).unionByName(fresh)

    return {
        "facts": facts,
        "hourly": later(hourly, "bucket", hour, edge_hour),
        "hourly_ip": later(hourly_ip, "bucket", hour, edge_hour_ip),
        "daily": later(t.daily, "day", F.lit(day), edge_day),
        "daily_ip": later(t.daily_ip, "day", F.lit(day), edge_day_ip),
        "first_seen": agg.first_seen(facts),
        "sessions": sessions,
        "session_state": session_state(sessions),
        "session_daily": later(t.session_daily, "day", F.lit(day), edge_sessions),
        "entry_daily": later(t.entry_daily, "day", F.lit(day), edge_entries),
    }


def replace_range(log: DataFrame, fresh: DataFrame, start: int, end: int) -> DataFrame:
    """Facts of ``[start, end)`` replaced by newly parsed ones; derived tables are built again from the result."""
    ts = F.col("timestamp")
    return log.filter((ts < start) | (ts >= end)).unionByName(between(fresh, start, end).select(*log.columns))
