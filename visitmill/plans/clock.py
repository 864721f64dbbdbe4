"""Named time ranges, their previous periods, and argument checks. Plain Python on the driver."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = ["today", "yesterday", "week", "last7days", "month", "last30days"]
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclasses.dataclass(frozen=True)
class Period:
    """Half-open ``[start, end)`` on raw rows; whole days ``start.date()..end.date()`` on daily tables."""

    start: dt.datetime
    end: dt.datetime
    zone: str = "UTC"

    @property
    def start_ts(self) -> int:
        return epoch(self.start, self.zone)

    @property
    def end_ts(self) -> int:
        return epoch(self.end, self.zone)

    @property
    def days(self) -> tuple[dt.date, dt.date]:
        return self.start.date(), self.end.date()


def epoch(moment: dt.datetime, zone: str = "UTC") -> int:
    return int(moment.replace(tzinfo=ZoneInfo(zone)).timestamp())


def wall_clock(zone: str = "UTC") -> dt.datetime:
    return dt.datetime.now(ZoneInfo(zone)).replace(tzinfo=None, microsecond=0)


def as_day(text: str) -> dt.date | None:
    if not _DAY.fullmatch(text or ""):
        return None
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


def _at(day: dt.date, hour: int = 0, minute: int = 0, second: int = 0) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(hour, minute, second))


def _whole(first: dt.date, last: dt.date, zone: str) -> Period:
    # Ranges stop at 23:59:59 and raw rows are filtered with "< end", so the last second stays outside.
    return Period(_at(first), _at(last, 23, 59, 59), zone)


def period(name: str, now: dt.datetime | None = None, zone: str = "UTC") -> Period:
    """The current period of a named range or of a ``YYYY-MM-DD`` date; unknown names mean today."""
    now = now or wall_clock(zone)
    today, one = now.date(), dt.timedelta(days=1)
    day = as_day(name)
    if day:
        return _whole(day, day, zone)
    if name == "yesterday":
        return _whole(today - one, today - one, zone)
    if name == "last7days":
        return _whole(today - 6 * one, today, zone)
    if name == "last30days":
        return _whole(today - 29 * one, today, zone)
    if name == "week":
        monday = today - today.weekday() * one
        return Period(_at(monday), _at(monday + 6 * one, 23), zone)
    if name == "month":
        first = today.replace(day=1)
        return Period(_at(first), _at(_next_month(first) - one, 23), zone)
    return _whole(today, today, zone)


def previous_period(name: str, now: dt.datetime | None = None, zone: str = "UTC") -> Period:
    """The period before: the day before, the week before, the calendar month before, or N days back."""
    now = now or wall_clock(zone)
    today, one = now.date(), dt.timedelta(days=1)
    current = period(name, now, zone)
    if name == "week":
        return Period(current.start - 7 * one, current.end - 7 * one, zone)
    if name == "month":
        last = current.start.date() - one
        return _whole(last.replace(day=1), last, zone)
    if name in ("last7days", "last30days"):
        span = 7 if name == "last7days" else 30
        return _whole(today - (2 * span - 1) * one, today - span * one, zone)
    return _whole(current.start.date() - one, current.start.date() - one, zone)


def _next_month(first: dt.date) -> dt.date:
    return (first + dt.timedelta(days=32)).replace(day=1)


_TIME_TEXTS = ["%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M"]


def parse_time_filter(text: str | int | None, zone: str = "UTC") -> int:
    """Epoch seconds or milliseconds, RFC 3339, or a local time text. 0 means "no bound"."""
    text = str(text or "").strip()
    if not text:
        return 0
    if re.fullmatch(r"[+-]?\d+", text):
        value = int(text)
        return value // 1000 if value > 1_000_000_000_000 else value
    for layout in _TIME_TEXTS:
        try:
            return epoch(dt.datetime.strptime(text, layout), zone)
        except ValueError:
            continue
    try:
        moment = dt.datetime.fromisoformat(text)
    except ValueError:
        moment = None
    if moment is None or moment.tzinfo is None or "T" not in text:
        raise ValueError(f"unsupported time text: {text}")
    return int(moment.timestamp())


def query_range(name: str = "", start: int = 0, end: int = 0, now: dt.datetime | None = None,
                zone: str = "UTC") -> tuple[int, int]:
    """Intersection of a named range with explicit bounds; 0 means open."""
    low = high = 0
    if name:
        base = period(name, now, zone)
        low, high = base.start_ts, base.end_ts
    if start > 0:
        low = max(low, start)
    if end > 0:
        high = min(high, end) if high else end
    return low, high


def visitor_range(name: str = "", start: int = 0, end: int = 0, now: dt.datetime | None = None,
                  zone: str = "UTC") -> tuple[int, int]:
    """The range that decides who counts as new: explicit bounds first, then the named range."""
    if start > 0 and end > 0:
        return start, end
    if name:
        base = period(name, now, zone)
        return base.start_ts, base.end_ts
    if start > 0:
        return start, epoch(now or wall_clock(zone), zone)
    return (0, end) if end > 0 else (0, 0)


def positive(name: str, value: int, default: int | None = None) -> int:
    """An integer argument that must be at least 1."""
    if value is None and default is not None:
        return default
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} must be an integer of at least 1")
    return value


def one_of(name: str, value: str, allowed: list[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


# ---- time columns ----------------------------------------------------------------------------------------------

def day_of(ts: Column | str) -> Column:
    """Local day in the session time zone."""
    return F.to_date(F.timestamp_seconds(F.col(ts) if isinstance(ts, str) else ts))


def hour_of(ts: Column | str) -> Column:
    """Epoch second at which the local hour starts."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(F.date_trunc("hour", F.timestamp_seconds(ts)))


def between(df: DataFrame, start: int = 0, end: int = 0, column: str = "timestamp") -> DataFrame:
    """``start <= ts < end`` (0 = open) plus whatever lets the scan skip data.

    Tables partitioned by ``day`` get the matching day range (a day of slack on both sides covers any zone);
    frames that carry their raw ``event_time`` get the same bounds on it, which Parquet statistics can use.
    """
    utc = dt.timezone.utc
    if start > 0:
        df = df.filter(F.col(column) >= start)
        low = dt.datetime.fromtimestamp(start, utc)
        if "day" in df.columns:
            df = df.filter(F.col("day") >= F.lit((low - dt.timedelta(days=1)).date()))
        if "event_time" in df.columns:
            df = df.filter(F.col("event_time") >= F.expr(f"TIMESTAMP_NTZ'{low:%Y-%m-%d %H:%M:%S}'"))
    if end > 0:
        df = df.filter(F.col(column) < end)
        high = dt.datetime.fromtimestamp(end, utc)
        if "day" in df.columns:
            df = df.filter(F.col("day") <= F.lit((high + dt.timedelta(days=1)).date()))
        if "event_time" in df.columns:
            df = df.filter(F.col("event_time") < F.expr(f"TIMESTAMP_NTZ'{high:%Y-%m-%d %H:%M:%S}'"))
    return df


def in_period(df: DataFrame, when: Period, column: str = "timestamp") -> DataFrame:
    return between(df, when.start_ts, when.end_ts, column)


def in_days(df: DataFrame, when: Period, column: str = "day") -> DataFrame:
    first, last = when.days
    return df.filter(F.col(column).between(F.lit(first), F.lit(last)))
