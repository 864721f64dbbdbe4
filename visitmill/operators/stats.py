"""Ranked statistics and time series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitmill.functions import labels
from visitmill.operators.shared import pageviews, percent, share, total_of
from visitmill.plans.clock import Period, as_day, between, epoch, in_days, in_period, one_of, positive
from visitmill.schema import CHINA


def ranked(log: DataFrame, when: Period, key: Column | str, limit: int | None = 10) -> DataFrame:
    """Page views and visitors per key, top ``limit`` by visitors (None: all keys), with percents of the rows returned."""
    key = F.col(key) if isinstance(key, str) else key
    keys = (pageviews(in_period(log, when)).groupBy(key.alias("key"))
            .agg(F.count("*").alias("pv"), F.countDistinct("ip").alias("uv")))
    if limit is None:
        whole = {c: keys.agg(F.sum(c)).scalar() for c in ("pv", "uv")}
        return keys.select("key", "pv", "uv", percent("pv", whole["pv"]).alias("pv_percent"), percent("uv", whole["uv"]).alias("uv_percent"))
    top = keys.orderBy(F.desc("uv"), F.desc("pv"), "key").limit(positive("limit", limit))
    return top.select(
        "key", "pv", "uv",
        percent("pv", total_of("pv")).alias("pv_percent"),
        percent("uv", total_of("uv")).alias("uv_percent"),
    )


def url_stats(log: DataFrame, when: Period, limit: int | None = 10) -> DataFrame:
    return ranked(log, when, "url", limit)


def referer_stats(log: DataFrame, when: Period, domains: list[str], limit: int | None = 10) -> DataFrame:
    return ranked(log, when, labels.referer_label("referer", domains), limit)


def referer_ip(log: DataFrame, when: Period, kind: str = "all", limit: int | None = 10) -> DataFrame:
    return ranked(log.filter(labels.of_source(kind)), when, "ip", limit)


def browser_stats(log: DataFrame, when: Period, limit: int | None = 10) -> DataFrame:
    return ranked(log, when, "browser", limit)


def os_stats(log: DataFrame, when: Period, limit: int | None = 10) -> DataFrame:
    return ranked(log, when, "os", limit)


def device_stats(log: DataFrame, when: Period, limit: int | None = 10) -> DataFrame:
    return ranked(log, when, "device", limit)


def location_stats(log: DataFrame, when: Period, kind: str = "domestic", limit: int = 10) -> DataFrame:
    """``domestic``: province; ``city``: what follows the province; ``global``: country."""
    one_of("kind", kind, ["domestic", "city", "global"])
    if kind == "global":
        return ranked(log, when, "global", limit)
    inside = log.filter(F.col("global") == CHINA)
    name = labels.before_dot("domestic") if kind == "domestic" else labels.after_dot("domestic")
    return ranked(inside, when, name, limit)


def referer_ip_batch(log: DataFrame, when: Period, limit: int = 10) -> DataFrame:
    """Top addresses by hits for every source kind, with share of all hits and most frequent place.

    One pass: hits are counted per (kind, ip, place) with map-side combine, and everything else works on those
    counts. The rank filter is applied before the shuffle by Spark's group limit.
    """
    rows = pageviews(in_period(log, when)).select("ip", "domestic", "global", labels.source_kinds().alias("kinds"))
    counts = (rows.groupBy("ip", "domestic", "global", "kinds").agg(F.count("*").alias("n"))
              .select(F.explode("kinds").alias("kind"), "ip", "n",
                      F.coalesce("domestic", F.lit("-")).alias("domestic"),
                      F.coalesce("global", F.lit("-")).alias("global"))
              .groupBy("kind", "ip", "global", "domestic").agg(F.sum("n").alias("n")))
    # Smallest of (-n, global, domestic): the most frequent place, ties by name.
    per_ip = counts.groupBy("kind", "ip").agg(
        F.sum("n").alias("hits"), F.min(F.struct((-F.col("n")).alias("m"), "global", "domestic")).alias("place"))
    totals = per_ip.groupBy("kind").agg(F.sum("hits").alias("total_hits"))
    order = Window.partitionBy("kind").orderBy(F.desc("hits"), "ip")
    top = per_ip.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positive("limit", limit))
    # Both sides hold at most four kinds.
    return top.join(F.broadcast(totals), "kind").select(
        "kind", "ip", "hits", share("hits", F.col("total_hits")).alias("share"),
        F.col("place.domestic").alias("domestic"), F.col("place.global").alias("global"), "total_hits",
        F.col("rank").cast("long").alias("rank"),
    )


# ---- dense time axes --------------------------------------------------------------------------------------------

# Weekday names, Sunday first.
WEEKDAYS = ["周日", "周一", "周二", "周三", "周四", "周五", "周六"]


def day_label(day: Column, weekday: bool = False) -> Column:
    """``M.D``, optionally followed by the weekday."""
    text = F.concat(F.month(day).cast("string"), F.lit("."), F.dayofmonth(day).cast("string"))
    if not weekday:
        return text
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return F.concat(text, F.lit(" "), F.element_at(names, F.dayofweek(day)))


def hour_label(bucket: Column) -> Column:
    return F.concat(F.hour(F.timestamp_seconds(bucket)).cast("string"), F.lit(":00"))


def _single_day(name: str) -> bool:
    return name in ("today", "yesterday") or as_day(name) is not None


def hour_spine(spark: SparkSession, when: Period) -> DataFrame:
    first, last = when.days
    hours = F.sequence(F.to_timestamp(F.lit(f"{first} 00:00:00")), F.to_timestamp(F.lit(f"{last} 23:00:00")),
                       F.expr("INTERVAL 1 HOUR"))
    return spark.range(1).select(F.explode(F.transform(hours, F.unix_seconds)).alias("bucket"))


def day_spine(spark: SparkSession, when: Period) -> DataFrame:
    first, last = when.days
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def _series(spine: DataFrame, pv: DataFrame, visitors: DataFrame, axis: str) -> DataFrame:
    """Zero rows of the spine are added to the counts, so empty buckets need no join."""
    zero = F.lit(0).cast("long")
    parts = (spine.select(axis, zero.alias("pageviews"), zero.alias("visitors"))
             .unionByName(pv.select(axis, F.col("pv").alias("pageviews"), zero.alias("visitors")))
             .unionByName(visitors.groupBy(axis).count().select(
                 axis, zero.alias("pageviews"), F.col("count").alias("visitors"))))
    return parts.groupBy(axis).agg(F.sum("pageviews").alias("pageviews"), F.sum("visitors").alias("visitors"))


def timeseries_hourly(hourly: DataFrame, hourly_ip: DataFrame, name: str, when: Period) -> DataFrame:
    """Every hour of the range from the hourly tables, empty hours as zero."""
    spine = hour_spine(hourly.sparkSession, when)
    first, last = (dt.datetime.combine(day, dt.time()) for day in when.days)
    keep = F.col("bucket").between(epoch(first, when.zone), epoch(last.replace(hour=23), when.zone))
    rows = _series(spine, hourly.filter(keep), hourly_ip.filter(keep), "bucket")
    bucket = F.col("bucket")
    label = hour_label(bucket) if _single_day(name) else day_label(F.to_date(F.timestamp_seconds(bucket)))
    return rows.select("bucket", label.alias("label"), "visitors", "pageviews",
                       (F.col("pageviews") - F.col("visitors")).alias("pv_minus_uv"))


def timeseries_daily(daily: DataFrame, daily_ip: DataFrame, name: str, when: Period) -> DataFrame:
    rows = _series(day_spine(daily.sparkSession, when), in_days(daily, when), in_days(daily_ip, when), "day")
    return rows.select("day", day_label(F.col("day"), name in ("last7days", "week")).alias("label"),
                       "visitors", "pageviews", (F.col("pageviews") - F.col("visitors")).alias("pv_minus_uv"))


def time_spine(log: DataFrame, step: str = "day", weekday: bool = True) -> DataFrame:
    """Dense days or hours from the first to the last row of a log, with labels."""
    one_of("step", step, ["day", "hour"])
    ends = log.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    if step == "hour":
        low, high = (F.date_trunc("hour", F.timestamp_seconds(c)) for c in ("a", "b"))
        rows = ends.select(F.explode(F.sequence(low, high, F.expr("INTERVAL 1 HOUR"))).alias("t"))
        return rows.select(F.unix_seconds("t").alias("bucket"), hour_label(F.unix_seconds("t")).alias("label"))
    low, high = (F.to_date(F.timestamp_seconds(c)) for c in ("a", "b"))
    rows = ends.select(F.explode(F.sequence(low, high)).alias("day"))
    return rows.select("day", day_label(F.col("day"), weekday).alias("label"))


def period_totals(log: DataFrame, periods: dict[str, Period]) -> DataFrame:
    """Rows and page views of several (overlapping) periods in one pass over the log."""
    ts, seen = F.col("timestamp"), F.col("pageview_flag") == 1
    inside = {n: (ts >= p.start_ts) & (ts < p.end_ts) for n, p in periods.items()}
    sums = []
    for name, cond in inside.items():
        sums += [F.count(F.when(cond, 1)).alias(f"{name}_hits"), F.count(F.when(cond & seen, 1)).alias(f"{name}_pv")]
    near = between(log, min(p.start_ts for p in periods.values()), max(p.end_ts for p in periods.values()))
    wide = near.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(n).alias("period"), F.lit(p.start_ts).cast("long").alias("start_ts"),
                 F.lit(p.end_ts).cast("long").alias("end_ts"),
                 F.col(f"{n}_hits").alias("hits"), F.col(f"{n}_pv").alias("pv"))
        for n, p in periods.items()])
    return wide.select(F.inline(rows))
