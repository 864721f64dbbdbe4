"""Sessions: runs of page views of one visitor with no gap above 1800 seconds.

A visitor may own a third of all rows, so rows are never lined up per visitor. They are first folded into slots
as wide as the gap: two page views in one slot are at most 1799 s apart, hence always in one session. That fold is
an ordinary aggregation with map-side combine. What is left per visitor is at most one row per half hour (48 a
day, whatever the traffic), and only those rows are ordered to join neighbouring slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitmill.operators.paging import Cursor, page
from visitmill.operators.shared import pageviews, share
from visitmill.plans.clock import Period, between, in_days, in_period, positive
from visitmill.schema import SESSION_GAP, VISITOR, scope


def slot_rows(log: DataFrame, gap: int = SESSION_GAP, details: bool = True) -> DataFrame:
    """Page views folded into (visitor, slot). Rows of several logs can be merged with ``merge_slots``."""
    slot = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(gap))).alias("slot")
    order = F.struct("timestamp", "id")
    measures = [
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.count("*").alias("pages"),
    ]
    if details:
        # The order travels with the page, so that partial slots can be merged later.
        measures += [
            F.min_by(F.struct("timestamp", "id", "url", "domestic", "global"), order).alias("entry"),
            F.max_by(F.struct("timestamp", "id", "url"), order).alias("exit"),
        ]
    return pageviews(log).groupBy(*scope(log, *VISITOR), slot).agg(*measures)


def merge_slots(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*scope(parts, *VISITOR), "slot").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("pages").alias("pages"),
        F.min_by("entry", F.struct("entry.timestamp", "entry.id")).alias("entry"),
        F.max_by("exit", F.struct("exit.timestamp", "exit.id")).alias("exit"))


def _joined(slots: DataFrame, gap: int, details: bool) -> DataFrame:
    keys = scope(slots, *VISITOR)
    by_time = Window.partitionBy(*keys).orderBy("slot")
    before = F.lag("last_ts").over(by_time)
    starts = F.when(before.isNull() | (F.col("first_ts") - before > gap), 1).otherwise(0)
    running = by_time.rowsBetween(Window.unboundedPreceding, 0)
    numbered = slots.withColumn("starts", starts).withColumn("session_no", F.sum("starts").over(running))
    measures = [
        F.min("first_ts").alias("start_ts"),
        F.max("last_ts").alias("end_ts"),
        F.sum("pages").alias("page_count"),
    ]
    if details:
        measures += [F.min_by("entry", "slot").alias("entry"), F.max_by("exit", "slot").alias("exit")]
    return numbered.groupBy(*keys, "session_no").agg(*measures)


def sessions_of_slots(slots: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    return _joined(slots, gap, details=True).select(
        *scope(slots, *VISITOR),
        F.col("entry.domestic").alias("domestic"),
        F.col("entry.global").alias("global"),
        "start_ts",
        "end_ts",
        F.col("entry.url").alias("entry_url"),
        F.col("exit.url").alias("exit_url"),
        "page_count",
    )


def sessionize(log: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """One row per session with its first location, entry and exit page."""
    return sessions_of_slots(slot_rows(log, gap), gap)


def session_bounds(log: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions without pages and locations: fixed-width buffers only, so it stays in hash aggregation."""
    return _joined(slot_rows(log, gap, details=False), gap, details=False).drop("session_no")


def session_window_agg(log: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Session counts and lengths per visitor with the built-in session window, over slots instead of rows."""
    keys = scope(log, *VISITOR)
    span = (F.col("last_ts") - F.col("first_ts") + gap).cast("string")
    window = F.session_window(F.timestamp_seconds("first_ts"), F.concat(span, F.lit(" seconds")))
    runs = slot_rows(log, gap, details=False).groupBy(*keys, window.alias("run")).agg(
        F.sum("pages").alias("pages"), (F.max("last_ts") - F.min("first_ts")).alias("length"))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("sessions"), F.sum("pages").alias("pages"), F.sum("length").alias("total_length"))


def session_state(sessions: DataFrame) -> DataFrame:
    """The latest session of each visitor."""
    return sessions.groupBy(*scope(sessions, *VISITOR)).agg(
        F.max_by("start_ts", "end_ts").alias("start_ts"), F.max("end_ts").alias("last_ts"))


def chained(blocks: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Blocks of page views (slots, or sessions of other batches) joined to sessions that keep what later blocks need.

    A block is a run of page views without a gap above ``gap``; blocks of one visitor may overlap and lie inside each other.
    """
    keys = scope(blocks, *VISITOR)
    by_time = Window.partitionBy(*keys).orderBy("first_ts", "last_ts")
    before = F.max("last_ts").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("first_ts") - before > gap), 1).otherwise(0)
    numbered = blocks.withColumn("_starts", starts).withColumn(
        "_no", F.sum("_starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_no").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("pages").alias("pages"),
        F.min_by("entry", F.struct("entry.timestamp", "entry.id")).alias("entry"),
        F.max_by("exit", F.struct("exit.timestamp", "exit.id")).alias("exit")).drop("_no")


def session_blocks(log: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions in the form that later page views can be merged into."""
    return chained(slot_rows(log, gap).drop("slot"), gap)


def sessions_of_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        *scope(blocks, *VISITOR), F.col("entry.domestic").alias("domestic"), F.col("entry.global").alias("global"),
        F.col("first_ts").alias("start_ts"), F.col("last_ts").alias("end_ts"), F.col("entry.url").alias("entry_url"),
        F.col("exit.url").alias("exit_url"), F.col("pages").alias("page_count"))


def reopened(old: DataFrame, new: DataFrame, gap: int = SESSION_GAP) -> tuple[DataFrame, DataFrame]:
    """Old blocks that new ones may touch, and those they cannot: of other visitors, or further away than the gap."""
    keys = scope(new, *VISITOR)
    touched = new.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("first_ts").alias("_low"), F.max("last_ts").alias("_high"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    marked = old.join(touched, same, "left")
    near = F.coalesce((F.col("last_ts") >= F.col("_low") - gap) & (F.col("first_ts") <= F.col("_high") + gap), F.lit(False))
    return marked.filter(near).select(*old.columns), marked.filter(~near).select(*old.columns)


def merge_sessions(old: DataFrame, new: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Blocks of ``old`` and ``new`` as one: what new page views cannot reach stays as it is, the rest is joined again.

    Old page views are not needed. A session is a block like any other: views that come late fall into it, extend it, or close the
    gap between two. ``streaming.session_table`` keeps such blocks and reads only those that a batch may reach.
    """
    again, kept = reopened(old, new, gap)
    return kept.unionByName(chained(again.unionByName(new), gap))


# ---- session statistics -----------------------------------------------------------------------------------------

def metrics_from_aggregates(session_daily: DataFrame, entry_daily: DataFrame, when: Period) -> DataFrame:
    """Session count and sessions per entry page from the daily tables."""
    total = in_days(session_daily, when).agg(F.coalesce(F.sum("sessions"), F.lit(0)).cast("long").alias("n"))
    entries = in_days(entry_daily, when).groupBy("entry_url").agg(F.sum("count").cast("long").alias("entries"))
    return entries.select("entry_url", "entries", total.scalar().alias("session_count"))


def metrics_from_sessions(sessions: DataFrame, when: Period) -> DataFrame:
    """The same from the session table: sessions that start in the range."""
    return _metrics(in_period(sessions, when, "start_ts"))


def metrics_from_logs(log: DataFrame, when: Period) -> DataFrame:
    """The same from raw rows: the range is cut first, so sessions that cross its edges are cut too."""
    return _metrics(sessionize(in_period(log, when)))


def _metrics(sessions: DataFrame) -> DataFrame:
    entries = sessions.groupBy("entry_url").agg(F.count("*").alias("entries"))
    total = sessions.agg(F.count("*").alias("n"))
    return entries.select("entry_url", "entries", total.scalar().alias("session_count"))


def session_metrics(when: Period, session_daily: DataFrame | None = None, entry_daily: DataFrame | None = None,
                    sessions: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Answered from the cheapest table at hand: daily aggregates, then sessions, then raw rows."""
    if session_daily is not None and entry_daily is not None:
        return metrics_from_aggregates(session_daily, entry_daily, when)
    if sessions is not None:
        return metrics_from_sessions(sessions, when)
    return metrics_from_logs(log, when)


def entry_pages(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """Top entry pages; percent of all entries, not of the rows shown."""
    total = metrics.agg(F.sum("entries").alias("n"))
    top = metrics.orderBy(F.desc("entries"), "entry_url").limit(limit)
    whole = total.scalar()
    rounded = F.round(F.col("entries").cast("double") / whole.cast("double") * 100).cast("long")
    return top.select(F.col("entry_url").alias("key"), F.col("entries").alias("uv"), rounded.alias("uv_percent"))


def session_filters(log: DataFrame, start: int = 0, end: int = 0, ip: str = "", device: str = "",
                    browser: str = "", os: str = "") -> DataFrame:
    """Row filters of the session list; ``end`` is inclusive here."""
    rows = between(log, start)
    if end > 0:
        rows = rows.filter(F.col("timestamp") <= end)
    for column, text in (("ip", ip), ("device", device), ("browser", browser), ("os", os)):
        if text.strip():
            rows = rows.filter(F.col(column).contains(text.strip()))
    return rows


SESSION_ORDER = [("start_ts", True), ("ip", False), ("browser", False), ("os", False), ("device", False)]


def session_list(log: DataFrame, when: Period | None = None, number: int = 1, size: int = 100,
                 after: Cursor | None = None, **filters) -> DataFrame:
    """Sessions of the filtered page views, newest first: the ``number``-th page, or the one that follows the cursor ``after``."""
    positive("size", size)
    rows = session_filters(in_period(log, when) if when else log, **filters)
    return page(sessionize(rows), SESSION_ORDER, positive("number", number), size, after).select(
        "ip", "domestic", "global", "device", "browser", "os", "start_ts", "end_ts",
        F.date_format(F.timestamp_seconds("start_ts"), "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        (F.col("end_ts") - F.col("start_ts")).alias("duration_seconds"),
        "page_count", "entry_url", "exit_url",
    )


def session_summary(log: DataFrame, when: Period | None = None) -> DataFrame:
    """Sessions, one-page sessions, their rate, and the mean length in whole seconds."""
    runs = session_bounds(in_period(log, when) if when else log)
    totals = runs.agg(
        F.count("*").alias("session_count"),
        F.count(F.when(F.col("page_count") <= 1, 1)).alias("bounce_count"),
        F.coalesce(F.sum(F.col("end_ts") - F.col("start_ts")), F.lit(0)).alias("length"),
    )
    mean: Column = F.when(F.col("session_count") > 0, F.expr("length div session_count")).otherwise(F.lit(0))
    return totals.select(
        "session_count", "bounce_count",
        share("bounce_count", F.col("session_count")).alias("bounce_rate"),
        mean.cast("long").alias("avg_duration_seconds"),
    )


