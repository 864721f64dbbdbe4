"""Statistics of the last minutes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.functions import labels
from visitmill.operators.sessions import sessionize
from visitmill.operators.shared import pageviews, share, total_of
from visitmill.plans.clock import between, epoch, wall_clock
from visitmill.schema import DESKTOP, PHONE, TABLET, UNKNOWN

# Names of the device groups.
DEVICE_GROUPS = {"pc": "PC端", "mobile": "移动端", "other": "其他"}


def bounds(now: dt.datetime | None = None, minutes: int = 30, zone: str = "UTC") -> tuple[int, int, int]:
    """Window start, end and length; 30 minutes unless said otherwise."""
    minutes = minutes if minutes and minutes > 0 else 30
    end = epoch(now or wall_clock(zone), zone)
    return end - minutes * 60, end, minutes


def window(log: DataFrame, now: dt.datetime | None = None, minutes: int = 30, zone: str = "UTC") -> DataFrame:
    start, end, _ = bounds(now, minutes, zone)
    return pageviews(between(log, start, end))


def realtime_active(log: DataFrame, now: dt.datetime | None = None, minutes: int = 30,
                     zone: str = "UTC") -> DataFrame:
    return window(log, now, minutes, zone).agg(F.countDistinct("ip").alias("active"))


def realtime_series(log: DataFrame, now: dt.datetime | None = None, minutes: int = 30,
                     zone: str = "UTC") -> DataFrame:
    """Visitors of every minute, from the minute the window starts in."""
    start, _, size = bounds(now, minutes, zone)
    first = start // 60
    seen = window(log, now, minutes, zone).select(F.expr("timestamp div 60").alias("minute"), "ip").distinct()
    counted = seen.groupBy("minute").agg(F.count("*").alias("uv"))
    spine = log.sparkSession.range(first, first + size).select(
        F.col("id").alias("minute"), F.lit(0).cast("long").alias("uv"))
    inside = counted.filter(F.col("minute").between(first, first + size - 1))
    return spine.unionByName(inside).groupBy("minute").agg(F.sum("uv").alias("uv"))


def realtime_devices(log: DataFrame, now: dt.datetime | None = None, minutes: int = 30,
                     zone: str = "UTC") -> DataFrame:
    """Visitors per device label, regrouped; a visitor with two device labels counts for both."""
    per_label = window(log, now, minutes, zone).groupBy("device").agg(F.countDistinct("ip").alias("uv"))
    device = F.col("device")
    group = (F.when(device == DESKTOP, "pc").when(device.isin(PHONE, TABLET), "mobile").otherwise("other"))
    wide = per_label.agg(*[F.coalesce(F.sum(F.when(group == g, F.col("uv"))), F.lit(0)).alias(g)
                           for g in DEVICE_GROUPS])
    total = sum((F.col(g) for g in DEVICE_GROUPS), F.lit(0))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(text).alias("name"), F.col(g).cast("long").alias("count"), share(g, total).alias("percent"))
        for g, text in DEVICE_GROUPS.items()])))


def _top(rows: DataFrame, key: Column, visitors: bool, limit: int) -> DataFrame:
    counted = F.countDistinct("ip") if visitors else F.count("*")
    top = rows.groupBy(key.alias("key")).agg(counted.alias("count")).orderBy(F.desc("count"), "key").limit(limit)
    name = F.when(F.trim("key") == "", UNKNOWN).otherwise(F.trim("key"))
    return top.select(name.alias("name"), "count", share("count", total_of("count")).alias("percent"))


def realtime_top(log: DataFrame, what: str, domains: list[str] | None = None, now: dt.datetime | None = None,
                 minutes: int = 30, limit: int = 10, zone: str = "UTC") -> DataFrame:
    """Top ``referers``, ``browsers``, ``locations`` by visitors or ``pages`` by hits."""
    keys = {
        "referers": labels.referer_label("referer", domains or []),
        "pages": F.col("url"),
        "browsers": F.col("browser"),
        "locations": labels.after_dot("domestic"),
    }
    return _top(window(log, now, minutes, zone), keys[what], what != "pages", limit)


def realtime_entry_pages(log: DataFrame, now: dt.datetime | None = None, minutes: int = 30,
                         limit: int = 10, zone: str = "UTC") -> DataFrame:
    """Entry pages of the sessions inside the window; share of all sessions in it."""
    runs = sessionize(window(log, now, minutes, zone))
    counts = runs.groupBy(F.col("entry_url").alias("name")).agg(F.count("*").alias("count"))
    whole = counts.agg(F.sum("count").alias("n")).scalar()
    top = counts.orderBy(F.desc("count"), "name").limit(limit)
    return top.select("name", "count", (F.col("count").cast("double") / whole.cast("double")).alias("percent"))
