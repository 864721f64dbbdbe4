"""The overall statistic: totals, status hits, visitors, comparison with the previous period, forecast."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.operators import aggregates as agg
from visitmill.operators.sessions import sessionize
from visitmill.operators.shared import count_where, one_row, pageviews, sum_where
from visitmill.plans.clock import Period, between, epoch, in_days, period, previous_period, wall_clock
from visitmill.schema import ACTIVE_MINUTES

STATUS = ["s2xx", "s3xx", "s4xx", "s5xx", "other"]
SNAPSHOT = ["pv", "uv", "sessions"]


@dataclasses.dataclass
class Tables:
    """The materialised tables of one site; any of them may be a lazy derivation or a stored table."""

    log: DataFrame
    daily: DataFrame
    daily_ip: DataFrame
    first_seen: DataFrame
    sessions: DataFrame
    session_daily: DataFrame
    entry_daily: DataFrame

    @classmethod
    def of(cls, log: DataFrame) -> "Tables":
        runs = sessionize(log)
        return cls(log, agg.agg_daily(log), agg.agg_daily_ip(log), agg.first_seen(log), runs,
                   agg.agg_session_daily(runs), agg.agg_entry_daily(runs))


def overall_totals(daily: DataFrame, daily_ip: DataFrame, when: Period) -> DataFrame:
    sums = in_days(daily, when).agg(*agg.counters_sum(daily, names=["pv", "traffic"]))
    visitors = in_days(daily_ip, when).agg(F.countDistinct("ip").alias("uv"))
    return one_row(sums, visitors)


def status_hits(daily: DataFrame, current: Period, previous: Period) -> DataFrame:
    """Status counters of both periods in one pass over the daily table, one row per period."""
    wide = near_days(daily, current, previous).agg(*_status_sums("current_", current), *_status_sums("previous_", previous))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("period"), *[F.col(f"{name}_{s}").alias(s) for s in STATUS])
        for name in ("current", "previous")])))


def near_days(table: DataFrame, *periods: Period) -> DataFrame:
    """The days from the first to the last of the periods: all that a conditional sum over them can need."""
    low, high = min(p.days[0] for p in periods), max(p.days[1] for p in periods)
    return table.filter(F.col("day").between(F.lit(low), F.lit(high)))


def near_times(rows: DataFrame, periods: list[Period], column: str) -> DataFrame:
    return between(rows, min(p.start_ts for p in periods), max(p.end_ts for p in periods), column)


def _status_sums(prefix: str, when: Period) -> list[Column]:
    return [sum_where(_on(when), s).alias(prefix + s) for s in STATUS]


def _on(when: Period) -> Column:
    first, last = when.days
    return F.col("day").between(F.lit(first), F.lit(last))


def active_visitors(log: DataFrame, now: dt.datetime | None = None, minutes: int = ACTIVE_MINUTES,
                    zone: str = "UTC") -> DataFrame:
    end = epoch(now or wall_clock(zone), zone)
    return pageviews(between(log, end - minutes * 60, end)).agg(F.countDistinct("ip").alias("active_visitors"))


def new_returning(daily_ip: DataFrame, first_seen: DataFrame, periods: dict[str, Period]) -> DataFrame:
    """New and returning visitors of several periods: one grouping by address, one join of unique keys."""
    flags = [F.max(_on(p)).alias(f"in_{n}") for n, p in periods.items()]
    active = near_days(daily_ip, *periods.values()).groupBy("ip").agg(*flags).join(first_seen, "ip", "left")
    first = F.col("first_ts")
    sums = []
    for name, p in periods.items():
        there = F.col(f"in_{name}")
        sums.append(count_where(there & (first >= p.start_ts) & (first < p.end_ts)).alias(f"{name}_new"))
        sums.append(count_where(there & (first < p.start_ts)).alias(f"{name}_returning"))
    wide = active.agg(*sums)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("period"), F.col(f"{n}_new").alias("new_visitors"),
                 F.col(f"{n}_returning").alias("returning_visitors")) for n in periods])))


# ---- comparison -------------------------------------------------------------------------------------------------

def compare_ranges(name: str, now: dt.datetime, zone: str = "UTC") -> tuple[dict[str, Period], dict]:
    """Labelled ranges of a comparison and the plain numbers a forecast needs."""
    current, previous = period(name, now, zone), previous_period(name, now, zone)
    upto = max(min(now, current.end), current.start)
    elapsed, total = upto - current.start, current.end - current.start
    progress = elapsed / total if total > dt.timedelta(0) else 1.0
    if not 0 < progress < 1:
        progress = 1.0
    ranges = {"current": current, "previous": previous}
    same_end = min(previous.start + elapsed, previous.end)
    ranges["same_time"] = Period(previous.start, same_end, zone) if same_end > previous.start else previous
    window = min(dt.timedelta(hours=2), elapsed)
    remaining = current.end - upto
    facts = {"progress": progress, "window": 0.0, "remaining": remaining.total_seconds(), "weight": 0.3}
    if remaining > dt.timedelta(0) and window >= dt.timedelta(minutes=30):
        ranges["window"] = Period(upto - window, upto, zone)
        facts["window"] = window.total_seconds()
    for limit, weight in ((7, 0.5), (1, 0.7)):
        if total <= dt.timedelta(days=limit):
            facts["weight"] = weight
    return ranges, facts


def snapshots(t: Tables, ranges: dict[str, Period], exact: bool = False) -> DataFrame:
    """Page views, visitors and sessions of all ranges in one row.

    By default a range covers the whole days it touches, as the daily tables give them; ``exact`` uses its
    bounds on raw rows and session starts.
    """
    if exact:
        def hit(p: Period, column: str) -> Column:
            return (F.col(column) >= p.start_ts) & (F.col(column) < p.end_ts)
        spans = list(ranges.values())
        views = pageviews(near_times(t.log, spans, "timestamp"))
        pv = views.agg(*[count_where(hit(p, "timestamp")).alias(f"{n}_pv") for n, p in ranges.items()])
        by_ip = views.groupBy("ip").agg(*[F.max(hit(p, "timestamp")).alias(n) for n, p in ranges.items()])
        runs = near_times(t.sessions, spans, "start_ts").agg(*[count_where(hit(p, "start_ts")).alias(f"{n}_sessions") for n, p in ranges.items()])
    else:
        daily, daily_ip, session_daily = (near_days(x, *ranges.values()) for x in (t.daily, t.daily_ip, t.session_daily))
        pv = daily.agg(*[sum_where(_on(p), "pv").alias(f"{n}_pv") for n, p in ranges.items()])
        by_ip = daily_ip.groupBy("ip").agg(*[F.max(_on(p)).alias(n) for n, p in ranges.items()])
        runs = session_daily.agg(*[sum_where(_on(p), "sessions").alias(f"{n}_sessions")
                                     for n, p in ranges.items()])
    uv = by_ip.agg(*[count_where(F.col(n)).alias(f"{n}_uv") for n in ranges])
    return one_row(pv, uv, runs)


def compare_snapshots(t: Tables, name: str, now: dt.datetime | None = None, zone: str = "UTC",
                      exact: bool = False) -> DataFrame:
    """Current, previous, same elapsed part of the previous period, and forecast: one row each."""
    now = now or wall_clock(zone)
    ranges, facts = compare_ranges(name, now, zone)
    wide = snapshots(t, ranges, exact)
    forecast = [forecast_column(m, facts).alias(f"forecast_{m}") for m in SNAPSHOT]
    shown = wide.select("*", *forecast)
    return shown.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("snapshot"), *[F.col(f"{n}_{m}").alias(m) for m in SNAPSHOT])
        for n in ("current", "previous", "same_time", "forecast")])))


def forecast_column(metric: str, facts: dict) -> Column:
    """Projection by progress, blended with the rate of the last two hours.

    The rate part is skipped in the first half hour, at the end of the period, and when the window saw nothing.
    """
    current = F.col(f"current_{metric}").cast("double")
    scale = 1 / facts["progress"]
    projected = F.round(current * F.lit(scale)) if facts["progress"] < 1 else current
    if not facts["window"]:
        return projected.cast("long")
    rate = F.col(f"window_{metric}").cast("double") / F.lit(facts["window"])
    by_rate = F.round(F.greatest(projected + rate * F.lit(facts["remaining"]), projected))
    weight = facts["weight"]
    blended = F.round(by_rate * F.lit(weight) + projected * F.lit(1 - weight))
    quiet = F.lit(True)
    for m in SNAPSHOT:
        quiet = quiet & (F.col(f"window_{m}") == 0)
    return F.when(quiet, projected).otherwise(blended).cast("long")


def overall(t: Tables, name: str, now: dt.datetime | None = None, zone: str = "UTC",
            exact: bool = False) -> DataFrame:
    """Everything above in one row."""
    now = now or wall_clock(zone)
    ranges, facts = compare_ranges(name, now, zone)
    current, previous = ranges["current"], ranges["previous"]
    wide = snapshots(t, ranges, exact)
    near = near_days(t.daily, current, previous).agg(sum_where(_on(current), "traffic").alias("traffic"),
                       *_status_sums("", current), *_status_sums("prev_", previous))
    visitors = new_returning(t.daily_ip, t.first_seen, {"current": current, "previous": previous})
    pivoted = visitors.agg(*[
        F.max(F.when(F.col("period") == p, F.col(c))).alias(alias)
        for p, c, alias in [
            ("current", "new_visitors", "new_visitors"), ("current", "returning_visitors", "returning_visitors"),
            ("previous", "new_visitors", "prev_new_visitors"),
            ("previous", "returning_visitors", "prev_returning_visitors")]])
    row = one_row(wide, near, pivoted, active_visitors(t.log, now, zone=zone))
    picks = [F.col(f"current_{m}").alias(m) for m in SNAPSHOT]
    for other in ("previous", "same_time"):
        picks += [F.col(f"{other}_{m}") for m in SNAPSHOT]
    picks += [forecast_column(m, facts).alias(f"forecast_{m}") for m in SNAPSHOT]
    rest = ["traffic", *STATUS, *[f"prev_{s}" for s in STATUS], "new_visitors", "returning_visitors",
            "prev_new_visitors", "prev_returning_visitors", "active_visitors"]
    return row.select(*picks, *rest)

