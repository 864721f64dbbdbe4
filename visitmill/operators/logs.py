"""Filtered, sorted and paged log rows."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.operators.aggregates import first_seen
from visitmill.operators.paging import Cursor, fetch, page, ways
from visitmill.operators.shared import lookup
from visitmill.plans.clock import between, one_of, period, positive, visitor_range
from visitmill.schema import BOT, CHINA, LOG_COLUMNS

SORT_FIELDS = ["timestamp", "ip", "url", "status_code", "bytes_sent", "request_length", "request_time_ms",
               "upstream_response_time_ms"]

# Textual prefixes of addresses that count as internal, and one exact address.
INTERNAL_PREFIXES = [
    "10.", "127.", "192.168.",
    "172.16.", "172.17.", "172.18.", "172.19.", "172.20.",
    "172.21.", "172.22.", "172.23.", "172.24.", "172.25.",
    "172.26.", "172.27.", "172.28.", "172.29.", "172.30.", "172.31.",
    "fc", "fd", "fe80:",
]
INTERNAL_ADDRESS = "::1"


def _has(column: str, text: str, wildcards: bool) -> Column:
    """Plain "contains"; with ``wildcards`` the text may hold ``%`` and ``_``."""
    return F.col(column).like(f"%{text}%") if wildcards else F.col(column).contains(text)


def f_keyword(text: str, wildcards: bool = False) -> Column:
    return (_has("url", text, wildcards) | _has("ip", text, wildcards) | _has("referer", text, wildcards)
            | _has("domestic", text, wildcards))


def f_ip(text: str, wildcards: bool = False) -> Column:
    return _has("ip", text, wildcards)


def f_url(text: str, wildcards: bool = False) -> Column:
    return _has("url", text, wildcards)


def f_location(text: str, wildcards: bool = False) -> Column:
    return _has("domestic", text, wildcards) | _has("global", text, wildcards)


def f_status(code: int = 0, status_class: str = "") -> Column:
    """An exact code wins over a class such as ``4xx``."""
    status = F.col("status_code")
    if code > 0:
        return status == code
    name = (status_class or "").lower()
    if name in ("2xx", "3xx", "4xx", "5xx"):
        low = int(name[0]) * 100
        return (status >= low) & (status < low + 100)
    return F.lit(True)


def f_exclude_internal() -> Column:
    ip = F.col("ip")
    inside = ip == INTERNAL_ADDRESS
    for prefix in INTERNAL_PREFIXES:
        inside = inside | ip.startswith(prefix)
    return ~inside


def f_exclude_spider() -> Column:
    return F.col("device") != BOT


def f_exclude_foreign() -> Column:
    return (F.col("global") == CHINA) | (F.lower("global") == "china")


def f_pageview_only() -> Column:
    return F.col("pageview_flag") == 1


@dataclasses.dataclass
class LogQuery:
    """Arguments of a log search."""

    keyword: str = ""
    time_range: str = ""
    time_start: int = 0
    time_end: int = 0
    ip: str = ""
    url: str = ""
    location: str = ""
    status_code: int = 0
    status_class: str = ""
    exclude_internal: bool = False
    exclude_spider: bool = False
    exclude_foreign: bool = False
    pageview_only: bool = False
    new_visitor: str = ""
    distinct_ip: bool = False
    sort_field: str = "timestamp"
    sort_order: str = "desc"
    page: int = 1
    page_size: int = 100
    after: Cursor | None = None
    wildcards: bool = False
    zone: str = "UTC"

    def check(self) -> "LogQuery":
        positive("page", self.page)
        positive("page_size", self.page_size)
        if self.sort_field not in SORT_FIELDS:
            self.sort_field = "timestamp"
        if self.sort_order not in ("asc", "desc"):
            self.sort_order = "desc"
        if self.new_visitor:
            one_of("new_visitor", self.new_visitor, ["new", "returning", "all"])
        return self


def matching(log: DataFrame, q: LogQuery, now: dt.datetime | None = None) -> DataFrame:
    """Rows that meet every filter of the query that needs no join."""
    rows = log
    if q.time_range:
        when = period(q.time_range, now, q.zone)
        rows = between(rows, when.start_ts, when.end_ts)
    if q.time_start > 0:
        rows = between(rows, q.time_start)
    if q.time_end > 0:
        rows = between(rows, 0, q.time_end + 1)
    texts = [(q.keyword, f_keyword), (q.ip.strip(), f_ip), (q.location.strip(), f_location), (q.url.strip(), f_url)]
    for text, rule in texts:
        if text:
            rows = rows.filter(rule(text, q.wildcards))
    if q.status_code > 0 or q.status_class:
        rows = rows.filter(f_status(q.status_code, q.status_class))
    switches = [(q.exclude_internal, f_exclude_internal), (q.exclude_spider, f_exclude_spider),
                (q.exclude_foreign, f_exclude_foreign), (q.pageview_only, f_pageview_only)]
    for on, rule in switches:
        if on:
            rows = rows.filter(rule())
    return rows


def with_visitor_flag(rows: DataFrame, seen: DataFrame, start: int, end: int, kind: str = "all") -> DataFrame:
    """``is_new_visitor`` from the first-seen table; ``kind`` keeps new or returning visitors only."""
    joined = lookup(rows, seen.select("ip", "first_ts"), "ip")
    first = F.col("first_ts")
    fresh = (first >= start) & (first < end)
    if kind == "new":
        joined = joined.filter(fresh)
    elif kind == "returning":
        joined = joined.filter(first < start)
    return joined.withColumn("is_new_visitor", F.when(fresh, 1).otherwise(0)).drop("first_ts")


def latest_per_ip(rows: DataFrame) -> DataFrame:
    """The newest row of each address, by aggregation: one address may hold a third of the log."""
    order = F.struct("timestamp", "id")
    columns = rows.columns
    return rows.groupBy("ip").agg(F.max_by(F.struct(*columns), order).alias("row")).select("row.*")


def _selected(log: DataFrame, q: LogQuery, now: dt.datetime | None, seen: DataFrame | None) -> DataFrame:
    rows = matching(log, q, now)
    if q.new_visitor:
        start, end = visitor_range(q.time_range, q.time_start, q.time_end, now, q.zone)
        rows = with_visitor_flag(rows, first_seen(log) if seen is None else seen, start, end, q.new_visitor)
    return rows


def order_of(q: LogQuery) -> list[tuple[str, bool]]:
    """The order of a search, for ``paging.next_cursor``."""
    q = q.check()
    return [(q.sort_field, q.sort_order == "desc"), ("id", q.sort_order == "desc")]


def logs(log: DataFrame, q: LogQuery, now: dt.datetime | None = None, seen: DataFrame | None = None) -> DataFrame:
    """One page of matching rows: the ``page``-th, or the one that follows the cursor ``after``.

    In time order the page is chosen by time and id alone, and whole rows are then read within its time bounds only. Other orders
    scatter a page over the log, so there the rows come along.
    """
    q = q.check()
    rows = _selected(log, q, now, seen)
    flags = [c for c in ("is_new_visitor",) if c in rows.columns]
    columns = [c for c in LOG_COLUMNS if c in rows.columns] + flags
    rows = rows.select(*columns)
    order = order_of(q)
    if q.sort_field == "timestamp":
        keys = rows.select("ip", "timestamp", "id")
        keys = page(latest_per_ip(keys) if q.distinct_ip else keys, order, q.page, q.page_size, q.after)
        shown = fetch(rows, keys.select("timestamp", "id"), order).orderBy(*ways(order))
    else:
        shown = page(latest_per_ip(rows) if q.distinct_ip else rows, order, q.page, q.page_size, q.after)
    text = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("time")
    return shown.select(*columns, text)


def logs_count(log: DataFrame, q: LogQuery, now: dt.datetime | None = None,
               seen: DataFrame | None = None) -> DataFrame:
    """Matching rows, or addresses, and the number of pages."""
    q = q.check()
    if q.new_visitor == "all":
        # Every row is kept, so the join with first-seen would change nothing.
        q = dataclasses.replace(q, new_visitor="")
    rows = _selected(log, q, now, seen)
    total = F.countDistinct("ip") if q.distinct_ip else F.count("*")
    return rows.agg(total.alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(q.page_size)).cast("long").alias("pages"))
