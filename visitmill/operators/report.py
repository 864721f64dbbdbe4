"""Daily report: a day against the day before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitmill.functions import labels
from visitmill.operators import overall as ov
from visitmill.operators import stats as st
from visitmill.operators.sessions import session_summary
from visitmill.operators.shared import one_row, pageviews, share, total_of
from visitmill.plans.clock import Period, in_period, period
from visitmill.schema import DIRECT, INTERNAL

# Referer labels of the direct group, system words of the device cards.
DIRECT_LABELS = [DIRECT, "direct", "-", "", INTERNAL, "internal"]
CARD_SYSTEMS = {"ios": "ios|iphone|ipad", "android": "android"}


def days(day: dt.date, zone: str = "UTC") -> tuple[Period, Period]:
    return period(str(day), zone=zone), period(str(day - dt.timedelta(days=1)), zone=zone)


def rate_of_change(current: Column | str, previous: Column | str) -> Column:
    """(current - previous) / previous; 0 when both are 0, NULL when only the previous value is."""
    current, previous = (F.col(c) if isinstance(c, str) else c for c in (current, previous))
    return (F.when((previous == 0) & (current == 0), F.lit(0.0)).when(previous == 0, F.lit(None).cast("double"))
            .otherwise((current - previous).cast("double") / previous.cast("double")))


def _compared(rows: DataFrame) -> DataFrame:
    """Adds delta and rate to (current, previous)."""
    return rows.withColumns({"delta": F.col("current") - F.col("previous"), "rate": rate_of_change("current", "previous")})


def kpi_day(t: ov.Tables, day: dt.date, zone: str = "UTC") -> DataFrame:
    """One row per metric: value, previous value, delta and rate."""
    now, before = days(day, zone)
    wide = ov.snapshots(t, {"current": now, "previous": before})
    frames = [wide]
    for name, when in (("current", now), ("previous", before)):
        frames.append(session_summary(t.log, when).select(
            F.col("bounce_rate").alias(f"{name}_bounce"), F.col("avg_duration_seconds").alias(f"{name}_duration")))
    row = one_row(*frames)
    for name in ("current", "previous"):
        row = row.withColumn(f"{name}_depth", share(f"{name}_pv", F.col(f"{name}_uv")))
    metrics = {"pv": "pv", "uv": "uv", "sessions": "sessions", "bounce_rate": "bounce", "avg_duration": "duration",
               "pv_per_visitor": "depth"}
    rows = row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"current_{c}").cast("double").alias("current"),
                 F.col(f"previous_{c}").cast("double").alias("previous")) for m, c in metrics.items()])))
    return _compared(rows)


def source_group(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return (F.when(F.lower(F.trim(label)).isin(*DIRECT_LABELS), "direct").when(labels.is_search(label), "search")
            .otherwise("external"))


def source_groups(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Visitors per source group of two referer rankings, which should hold all referers (``limit=None``)."""
    groups = ["search", "direct", "external"]

    def wide(ranking: DataFrame, name: str) -> DataFrame:
        return ranking.agg(*[F.coalesce(F.sum(F.when(source_group("key") == g, F.col("uv"))), F.lit(0)).alias(f"{g}_{name}")
                             for g in groups])

    row = one_row(wide(current, "c"), wide(previous, "p"))
    return _compared(row.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("source"), F.col(f"{g}_c").alias("current"), F.col(f"{g}_p").alias("previous"))
        for g in groups]))))


def top_with_previous(log: DataFrame, day: dt.date, key: Column | str, limit: int = 10, search_only: bool = False,
                      as_reference: bool = False, zone: str = "UTC") -> DataFrame:
    """The day's ranking with the previous day's values.

    ``search_only`` ranks search engines alone (``as_reference`` picks them out of the ranking of all). The previous value
    of a key comes from the whole previous day; ``as_reference`` looks at the previous top rows only and counts anything
    else as 0.
    """
    key = F.col(key) if isinstance(key, str) else key
    now, before = days(day, zone)
    asked = log.filter(labels.is_search(key)) if search_only and not as_reference else log
    top = st.ranked(asked, now, key, limit).select("key", "pv", "uv", share("uv", total_of("uv")).alias("share"))
    if search_only and as_reference:
        top = top.filter(labels.is_search("key"))
    if as_reference:
        past = st.ranked(log, before, key, limit)
    else:
        past = pageviews(in_period(log, before)).groupBy(key.alias("key")).agg(
            F.count("*").alias("pv"), F.countDistinct("ip").alias("uv"))
    past = past.select("key", F.col("pv").alias("previous_pv"), F.col("uv").alias("previous_uv"))
    zero = F.lit(0).cast("long")
    both = top.join(past, "key", "left").withColumns({
        "previous_pv": F.coalesce("previous_pv", zero), "previous_uv": F.coalesce("previous_uv", zero)})
    return both.select(
        "key", "pv", "uv", "share", "previous_pv", "previous_uv", (F.col("uv") - F.col("previous_uv")).alias("delta"),
        rate_of_change("pv", "previous_pv").alias("pv_rate"), rate_of_change("uv", "previous_uv").alias("uv_rate"))


def region_text(domestic: str = "domestic", country: str = "global") -> Column:
    def clean(c: str) -> Column:
        return F.when(F.trim(c) == "-", "").otherwise(F.coalesce(F.trim(c), F.lit("")))
    place, land = clean(domestic), clean(country)
    return (F.when((land != "") & (place != "") & (land != place), F.concat(land, F.lit(" · "), place))
            .when(place != "", place).when(land != "", land).otherwise("-"))


def source_ip_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Top addresses per source kind with the hits they had in the previous ranking."""
    past = previous.select("kind", "ip", F.col("hits").alias("previous"))
    both = current.join(past, ["kind", "ip"], "left").withColumns({
        "current": F.col("hits"), "previous": F.coalesce("previous", F.lit(0).cast("long"))})
    return _compared(both).select("kind", "ip", "current", "previous", "delta", "rate", "share",
                                  region_text().alias("region"))


def movers(top: DataFrame) -> DataFrame:
    """Fastest rising and falling key of a ranking with previous values; keys without a rate do not count."""
    order = Window.orderBy(F.desc("uv"), F.desc("pv"), "key")
    # At most the N rows of a top-N ranking.
    rows = top.withColumn("_n", F.row_number().over(order)).filter(F.col("uv_rate").isNotNull())
    up, down = F.struct("uv_rate", -F.col("_n")), F.struct("uv_rate", "_n")
    return rows.agg(F.max_by("key", up).alias("rising"), F.max("uv_rate").alias("rising_rate"),
                    F.min_by("key", down).alias("falling"), F.min("uv_rate").alias("falling_rate"))


def visitor_split(t: ov.Tables, day: dt.date, zone: str = "UTC") -> DataFrame:
    """New and returning visitors: share, rate against the day before, mean session length, pages per visitor."""
    now, before = days(day, zone)
    split = ov.new_returning(t.daily_ip, t.first_seen, {"current": now, "previous": before})
    wide = split.agg(*[F.max(F.when(F.col("period") == p, F.col(f"{k}_visitors"))).alias(f"{k}_{p}")
                       for p in ("current", "previous") for k in ("new", "returning")])
    row = one_row(wide, ov.overall_totals(t.daily, t.daily_ip, now), session_summary(t.log, now))
    whole = F.col("new_current") + F.col("returning_current")
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("visitor"), F.col(f"{k}_current").alias("visitors"),
                 share(f"{k}_current", whole).alias("share"),
                 rate_of_change(f"{k}_current", f"{k}_previous").alias("rate"),
                 F.col("avg_duration_seconds"), share("pv", F.col("uv")).alias("pv_per_visitor"))
        for k in ("new", "returning")])))


def device_cards(devices: DataFrame, systems: DataFrame) -> DataFrame:
    """Desktop, iOS and Android visitors of a device and a system ranking of all keys."""
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("uv"))), F.lit(0)).cast("long")
    desktop = devices.agg(total(labels.device_group("key") == "desktop").alias("desktop"))
    rest = systems.agg(*[total(F.lower("key").rlike(words)).alias(n) for n, words in CARD_SYSTEMS.items()])
    return one_row(desktop, rest)


def peak_trough_hour(series: DataFrame) -> DataFrame:
    """First hour with most and first hour with fewest visitors of an hourly series."""
    hour = F.hour(F.timestamp_seconds("bucket"))
    rows = series.select(hour.alias("h"), "visitors")
    return rows.agg(F.max_by("h", F.struct("visitors", -F.col("h"))).alias("peak_hour"),
                    F.min_by("h", F.struct("visitors", F.col("h"))).alias("trough_hour"))


def device_totals(devices: DataFrame) -> DataFrame:
    """Visitors per device group of a ranking of all devices, with percent of all, two decimals."""
    names = ["desktop", "mobile", "other"]
    wide = devices.agg(*[F.coalesce(F.sum(F.when(labels.device_group("key") == n, F.col("uv"))), F.lit(0)).alias(n)
                         for n in names])
    whole = sum((F.col(n) for n in names), F.lit(0))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("device"), F.col(n).alias("visitors"),
                 F.round(share(n, whole) * 100, 2).alias("percent")) for n in names])))


def status_totals(hits: DataFrame) -> DataFrame:
    """Totals of the four status classes of both periods and their change in percent; NULL without a past."""
    shown = ["s2xx", "s3xx", "s4xx", "s5xx"]
    both = hits.withColumn("total", sum((F.col(c) for c in shown[1:]), F.col(shown[0])))
    current = [F.max(F.when(F.col("period") == "current", F.col(c))).alias(c) for c in [*shown, "total"]]
    row = both.agg(*current, F.max(F.when(F.col("period") == "previous", F.col("total"))).alias("previous_total"))
    delta = (F.col("total") - F.col("previous_total")).cast("double") / F.col("previous_total").cast("double") * 100
    return row.withColumn("delta_percent", F.when(F.col("previous_total") > 0, delta))
