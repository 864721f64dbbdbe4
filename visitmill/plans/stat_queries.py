"""Registered queries: tables, sessions, statistics, realtime, log search."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import functions as F

from visitmill.functions import labels
from visitmill.operators import aggregates as agg
from visitmill.operators import logs as lg
from visitmill.operators import overall as ov
from visitmill.operators import paging
from visitmill.operators import realtime as rt
from visitmill.operators import sessions as ss
from visitmill.operators import stats as st
from visitmill.plans.clock import day_of, hour_of, period, previous_period
from visitmill.plans.fixture import NOW, OWN_DOMAINS, access_log
from visitmill.plans.oracle import VISITOR, day, hour, over_log, sessions_of
from visitmill.plans.registry import Registry

REG = Registry()
MONTH = period("last30days", NOW)
WEEK = period("last7days", NOW)
BACK = previous_period("last7days", NOW)
IN_MONTH = f"timestamp >= {MONTH.start_ts} AND timestamp < {MONTH.end_ts}"
SPLIT = 1705276800  # 2024-01-15 00:00 UTC: old rows before, new rows after


def q(name, build, body, *ctes):
    """Register a query over the access log; ``build`` takes the log frame."""
    REG.add(name, lambda spark, sf: build(access_log(spark, sf)), over_log(body, *ctes) if body else None)


# ---- 2.5 materialised aggregates --------------------------------------------------------------------------------

for _name, _fn in [("agg_hourly", agg.agg_hourly), ("agg_hourly_ip", agg.agg_hourly_ip),
                   ("agg_daily", agg.agg_daily), ("agg_daily_ip", agg.agg_daily_ip)]:
    q(_name, _fn, f"SELECT * FROM {_name[4:]}", _name[4:])
q("first_seen", agg.first_seen, "SELECT * FROM first_seen", "first_seen")
q("sessionize", ss.sessionize, "SELECT * FROM sessions", "sessions")
q("session_window_agg", ss.session_window_agg,
  f"""SELECT {VISITOR}, count(*) AS sessions, CAST(sum(page_count) AS BIGINT) AS pages,
  CAST(sum(end_ts - start_ts) AS BIGINT) AS total_length FROM sessions GROUP BY {VISITOR}""", "sessions")
q("session_state", lambda log: ss.session_state(ss.sessionize(log)),
  f"""SELECT {VISITOR}, start_ts, end_ts AS last_ts FROM (SELECT *, row_number() OVER
  (PARTITION BY {VISITOR} ORDER BY end_ts DESC) AS rn FROM sessions) WHERE rn = 1""", "sessions")
q("agg_session_daily", lambda log: agg.agg_session_daily(ss.sessionize(log)),
  "SELECT * FROM session_daily", "session_daily")
q("agg_entry_daily", lambda log: agg.agg_entry_daily(ss.sessionize(log)),
  "SELECT * FROM entry_daily", "entry_daily")


def _halves(log):
    return log.filter(F.col("timestamp") < SPLIT), log.filter(F.col("timestamp") >= SPLIT)


def _merged(build, merge):
    def run(log):
        old, new = _halves(log)
        return merge(build(old), build(new))
    return run


q("merge_additive", _merged(agg.agg_hourly, lambda a, b: agg.merge_additive(a, b, ["bucket"])),
  "SELECT * FROM hourly", "hourly")
q("merge_additive_sessions",
  _merged(lambda log: agg.agg_session_daily(ss.sessionize(log)), lambda a, b: agg.merge_additive(a, b, ["day"])),
  f"""SELECT day, CAST(sum(n) AS BIGINT) AS sessions FROM (
  SELECT {day('start_ts')} AS day, count(*) AS n FROM a GROUP BY 1 UNION ALL
  SELECT {day('start_ts')} AS day, count(*) AS n FROM b GROUP BY 1) GROUP BY day""",
  f"old AS (SELECT * FROM access_log WHERE timestamp < {SPLIT})",
  f"fresh AS (SELECT * FROM access_log WHERE timestamp >= {SPLIT})", sessions_of("old", "a"),
  sessions_of("fresh", "b"))
q("merge_min", _merged(agg.first_seen, lambda a, b: agg.merge_min(a, b, ["ip"])),
  "SELECT * FROM first_seen", "first_seen")
q("merge_set", _merged(agg.agg_daily_ip, agg.merge_set), "SELECT * FROM daily_ip", "daily_ip")


def _merge_sessions(log):
    old, new = _halves(log)
    return ss.sessions_of_blocks(ss.merge_sessions(ss.session_blocks(old), ss.session_blocks(new)))


q("merge_sessions", _merge_sessions, "SELECT * FROM sessions", "sessions")

_BUCKET = 1704844800  # 2024-01-10 00:00 UTC
_DAY = dt.date(2024, 1, 10)


def _rebuild_hour(log):
    table = agg.agg_hourly(log)
    fresh, _ = agg.rebuild_hour(log, _BUCKET)
    return agg.put_bucket(table, fresh, "bucket", F.lit(_BUCKET))


def _rebuild_day(log):
    table = agg.agg_daily(log)
    fresh, _ = agg.rebuild_day(log, _DAY)
    return agg.put_bucket(table, fresh, "day", F.lit(_DAY))


def _rebuild_session_day(log):
    runs = ss.sessionize(log)
    fresh, _ = agg.rebuild_session_day(runs, _DAY)
    return agg.put_bucket(agg.agg_session_daily(runs), fresh, "day", F.lit(_DAY))


q("rebuild_hour", _rebuild_hour, "SELECT * FROM hourly", "hourly")
q("rebuild_day", _rebuild_day, "SELECT * FROM daily", "daily")
q("rebuild_session_day", _rebuild_session_day, "SELECT * FROM session_daily", "session_daily")

# ---- 2.6 periods and buckets ------------------------------------------------------------------------------------

PERIODS = {n: period(n, NOW) for n in ["today", "yesterday", "week", "last7days", "month", "last30days"]}
PERIODS |= {f"previous_{n}": previous_period(n, NOW) for n in list(PERIODS)}
PERIODS["day_2024_01_15"] = period("2024-01-15", NOW)

# Bounds written out by date arithmetic in SQL, independent of the Python code.
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_T = f"date_trunc('day', {_NOW})"
_W, _M = f"date_trunc('week', {_NOW})", f"date_trunc('month', {_NOW})"


def _d(n):
    return f"({_T} - INTERVAL {n} DAY)"


def _last(n):
    return f"({_T} - INTERVAL {n} DAY + INTERVAL 86399 SECOND)"


_BOUNDS = {
    "today": (_d(0), _last(0)), "yesterday": (_d(1), _last(1)),
    "week": (_W, f"({_W} + INTERVAL 6 DAY + INTERVAL 23 HOUR)"),
    "last7days": (_d(6), _last(0)),
    "month": (_M, f"({_M} + INTERVAL 1 MONTH - INTERVAL 1 HOUR)"),
    "last30days": (_d(29), _last(0)),
    "previous_today": (_d(1), _last(1)), "previous_yesterday": (_d(2), _last(2)),
    "previous_week": (f"({_W} - INTERVAL 7 DAY)", f"({_W} - INTERVAL 1 DAY + INTERVAL 23 HOUR)"),
    "previous_last7days": (_d(13), _last(7)),
    "previous_month": (f"({_M} - INTERVAL 1 MONTH)", f"({_M} - INTERVAL 1 SECOND)"),
    "previous_last30days": (_d(59), _last(30)),
    "day_2024_01_15": ("TIMESTAMP '2024-01-15'", "TIMESTAMP '2024-01-15 23:59:59'"),
}
_PERIOD_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS period, CAST(epoch({a}) AS BIGINT) AS start_ts, CAST(epoch({b}) AS BIGINT) AS end_ts"
    for n, (a, b) in _BOUNDS.items())
q("period_table", lambda log: st.period_totals(log, PERIODS),
  """SELECT period, start_ts, end_ts, count(l.id) AS hits, count(CASE WHEN pageview_flag = 1 THEN 1 END) AS pv
  FROM periods p LEFT JOIN access_log l ON l.timestamp >= p.start_ts AND l.timestamp < p.end_ts GROUP BY ALL""",
  f"periods AS ({_PERIOD_ROWS})")

_ENDS = "ends AS (SELECT min(timestamp) AS a, max(timestamp) AS b FROM access_log)"
q("time_spine", st.time_spine,
  f"""SELECT day, concat(CAST(month(day) AS VARCHAR), '.', CAST(day(day) AS VARCHAR), ' ',
  ['周日','周一','周二','周三','周四','周五','周六'][dayofweek(day) + 1]) AS label FROM (
  SELECT CAST(unnest(generate_series({day('a')}, {day('b')}, INTERVAL 1 DAY)) AS DATE) AS day FROM ends)""", _ENDS)
q("time_spine_hours", lambda log: st.time_spine(log, "hour"),
  f"""SELECT bucket, concat(CAST((bucket // 3600) % 24 AS VARCHAR), ':00') AS label FROM (
  SELECT unnest(range({hour('a')}, {hour('b')} + 1, 3600)) AS bucket FROM ends)""", _ENDS)
q("hour_bucket", lambda log: log.select("id", hour_of("timestamp").alias("bucket")),
  f"SELECT id, {hour()} AS bucket FROM access_log")
q("day_bucket", lambda log: log.select("id", day_of("timestamp").alias("day")),
  f"SELECT id, {day()} AS day FROM access_log")

# ---- 2.7 statistics ---------------------------------------------------------------------------------------------

_HOUR_SERIES = """SELECT s.bucket, {label} AS label, coalesce(u.uv, 0) AS visitors, coalesce(h.pv, 0) AS pageviews,
 coalesce(h.pv, 0) - coalesce(u.uv, 0) AS pv_minus_uv
 FROM (SELECT unnest(range({a}, {b}, 3600)) AS bucket) s LEFT JOIN hourly h ON h.bucket = s.bucket
 LEFT JOIN (SELECT bucket, count(*) AS uv FROM hourly_ip GROUP BY bucket) u ON u.bucket = s.bucket"""
_HDAY = day("s.bucket")


def _hourly(name):
    return lambda log: st.timeseries_hourly(agg.agg_hourly(log), agg.agg_hourly_ip(log), name, period(name, NOW))


def _daily(name):
    return lambda log: st.timeseries_daily(agg.agg_daily(log), agg.agg_daily_ip(log), name, period(name, NOW))


q("timeseries_hourly", _hourly("last30days"), _HOUR_SERIES.format(
    a=MONTH.start_ts, b=MONTH.end_ts,
    label=f"concat(CAST(month({_HDAY}) AS VARCHAR), '.', CAST(day({_HDAY}) AS VARCHAR))"), "hourly", "hourly_ip")
_Y = PERIODS["yesterday"]
q("timeseries_hourly_day", _hourly("yesterday"), _HOUR_SERIES.format(
    a=_Y.start_ts, b=_Y.end_ts, label="concat(CAST((s.bucket // 3600) % 24 AS VARCHAR), ':00')"),
  "hourly", "hourly_ip")
_DAY_SERIES = """SELECT s.day, {label} AS label, coalesce(u.uv, 0) AS visitors, coalesce(h.pv, 0) AS pageviews,
 coalesce(h.pv, 0) - coalesce(u.uv, 0) AS pv_minus_uv
 FROM (SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS DATE) AS day) s
 LEFT JOIN daily h ON h.day = s.day
 LEFT JOIN (SELECT day, count(*) AS uv FROM daily_ip GROUP BY day) u ON u.day = s.day"""
_SHORT = "concat(CAST(month(s.day) AS VARCHAR), '.', CAST(day(s.day) AS VARCHAR))"
q("timeseries_daily", _daily("last30days"), _DAY_SERIES.format(a="2024-01-02", b="2024-01-31", label=_SHORT),
  "daily", "daily_ip")
q("timeseries_daily_week", _daily("last7days"), _DAY_SERIES.format(
    a="2024-01-25", b="2024-01-31",
    label=f"concat({_SHORT}, ' ', ['周日','周一','周二','周三','周四','周五','周六'][dayofweek(s.day) + 1])"),
  "daily", "daily_ip")

_DAYS = "day BETWEEN DATE '{0}' AND DATE '{1}'"
_M_DAYS = _DAYS.format(*MONTH.days)
_W_DAYS, _B_DAYS = _DAYS.format(*WEEK.days), _DAYS.format(*BACK.days)
q("overall_totals", lambda log: ov.overall_totals(agg.agg_daily(log), agg.agg_daily_ip(log), MONTH),
  f"""SELECT CAST(coalesce(sum(pv), 0) AS BIGINT) AS pv, CAST(coalesce(sum(traffic), 0) AS BIGINT) AS traffic,
  (SELECT count(DISTINCT ip) FROM daily_ip WHERE {_M_DAYS}) AS uv FROM daily WHERE {_M_DAYS}""", "daily", "daily_ip")


def _status_row(name, days):
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ov.STATUS)
    return f"SELECT '{name}' AS period, {sums} FROM daily WHERE {days}"


q("status_hits", lambda log: ov.status_hits(agg.agg_daily(log), WEEK, BACK),
  _status_row("current", _W_DAYS) + " UNION ALL " + _status_row("previous", _B_DAYS), "daily")

_METRICS = """SELECT entry_url, count(*) AS entries, (SELECT count(*) FROM {t}) AS session_count
 FROM {t} GROUP BY entry_url"""


def _month_metrics(log):
    runs = ss.sessionize(log)
    return ss.session_metrics(MONTH, agg.agg_session_daily(runs), agg.agg_entry_daily(runs))


q("session_metrics", _month_metrics,
  f"""SELECT entry_url, CAST(sum("count") AS BIGINT) AS entries,
  (SELECT CAST(coalesce(sum(sessions), 0) AS BIGINT) FROM session_daily WHERE {_M_DAYS}) AS session_count
  FROM entry_daily WHERE {_M_DAYS} GROUP BY entry_url""", "session_daily", "entry_daily")
q("session_metrics_sessions", lambda log: ss.session_metrics(MONTH, sessions=ss.sessionize(log)),
  _METRICS.format(t="cut"), "sessions",
  f"cut AS (SELECT * FROM sessions WHERE start_ts >= {MONTH.start_ts} AND start_ts < {MONTH.end_ts})")
q("session_metrics_logs", lambda log: ss.session_metrics(MONTH, log=log), _METRICS.format(t="cut"),
  f"part AS (SELECT * FROM access_log WHERE {IN_MONTH})", sessions_of("part", "cut"))
q("entry_pages", lambda log: ss.entry_pages(_month_metrics(log), 10),
  f"""SELECT entry_url AS "key", uv, CAST(round(CAST(uv AS DOUBLE) / (SELECT sum("count") FROM entry_daily
  WHERE {_M_DAYS}) * 100) AS BIGINT) AS uv_percent FROM (SELECT entry_url, CAST(sum("count") AS BIGINT) AS uv
  FROM entry_daily WHERE {_M_DAYS} GROUP BY entry_url ORDER BY uv DESC, entry_url LIMIT 10)""", "entry_daily")

# The busiest evening of the test period is as good an instant as any.
LATE = dt.datetime(2024, 1, 30, 23, 30)
_LATE = int(LATE.replace(tzinfo=dt.timezone.utc).timestamp())
q("active_visitors", lambda log: ov.active_visitors(log, LATE),
  f"""SELECT count(DISTINCT ip) AS active_visitors FROM access_log
  WHERE pageview_flag = 1 AND timestamp >= {_LATE - 900} AND timestamp < {_LATE}""")


def _nr(name, p):
    first, last = p.days
    return f"""SELECT '{name}' AS period,
  count(CASE WHEN first_ts >= {p.start_ts} AND first_ts < {p.end_ts} THEN 1 END) AS new_visitors,
  count(CASE WHEN first_ts < {p.start_ts} THEN 1 END) AS returning_visitors
  FROM (SELECT DISTINCT ip FROM daily_ip WHERE day BETWEEN DATE '{first}' AND DATE '{last}') a
  LEFT JOIN first_seen USING (ip)"""


_FIRST_WEEK = {"current": period("2024-01-02", NOW), "previous": period("2024-01-01", NOW)}
q("new_returning", lambda log: ov.new_returning(agg.agg_daily_ip(log), agg.first_seen(log), _FIRST_WEEK),
  " UNION ALL ".join(_nr(n, p) for n, p in _FIRST_WEEK.items()), "daily_ip", "first_seen")


def _snap(name, p):
    days = _DAYS.format(*p.days)
    return f"""SELECT '{name}' AS snapshot,
  (SELECT CAST(coalesce(sum(pv), 0) AS BIGINT) FROM daily WHERE {days}) AS pv,
  (SELECT count(DISTINCT ip) FROM daily_ip WHERE {days}) AS uv,
  (SELECT CAST(coalesce(sum(sessions), 0) AS BIGINT) FROM session_daily WHERE {days}) AS sessions"""


_RANGES, _FACTS = ov.compare_ranges("last7days", NOW)
_SNAPS = ("s AS (" + " UNION ALL ".join(_snap(n, p) for n, p in _RANGES.items()) + ")")
# 6 of 7 days (less a second) are over; the window is two hours; one day less a second is left; weight 0.5.
_P, _REM = "(518400.0 / 604799.0)", "86399.0"


def _fc(m):
    base = f"round(c.{m} * (1 / {_P}))"
    rate = f"round({base} + w.{m} / 7200.0 * {_REM})"
    return f"CAST(round({rate} * 0.5 + {base} * 0.5) AS BIGINT) AS {m}"


_FORECAST = (f"SELECT 'forecast' AS snapshot, {', '.join(_fc(m) for m in ov.SNAPSHOT)} FROM "
             "(SELECT * FROM s WHERE snapshot = 'current') c, (SELECT * FROM s WHERE snapshot = 'window') w")
q("compare_snapshots", lambda log: ov.compare_snapshots(ov.Tables.of(log), "last7days", NOW),
  f"SELECT * FROM s WHERE snapshot <> 'window' UNION ALL {_FORECAST}",
  "daily", "daily_ip", "session_daily", _SNAPS)
q("forecast", lambda log: ov.compare_snapshots(ov.Tables.of(log), "last7days", NOW)
  .filter(F.col("snapshot") == "forecast"), _FORECAST, "daily", "daily_ip", "session_daily", _SNAPS)
_O, _OF = ov.compare_ranges("yesterday", NOW)


def _overall_sql():
    cur, prev = _O["current"], _O["previous"]
    cd, pd_ = _DAYS.format(*cur.days), _DAYS.format(*prev.days)
    picks = ["SELECT c.pv, c.uv, c.sessions, p.pv AS previous_pv, p.uv AS previous_uv, "
             "p.sessions AS previous_sessions, t.pv AS same_time_pv, t.uv AS same_time_uv, "
             "t.sessions AS same_time_sessions, c.pv AS forecast_pv, c.uv AS forecast_uv, "
             "c.sessions AS forecast_sessions",
             f"(SELECT CAST(coalesce(sum(traffic), 0) AS BIGINT) FROM daily WHERE {cd}) AS traffic"]
    for s in ov.STATUS:
        picks.append(f"(SELECT CAST(coalesce(sum({s}), 0) AS BIGINT) FROM daily WHERE {cd}) AS {s}")
        picks.append(f"(SELECT CAST(coalesce(sum({s}), 0) AS BIGINT) FROM daily WHERE {pd_}) AS prev_{s}")
    picks += ["nc.new_visitors", "nc.returning_visitors", "np.new_visitors AS prev_new_visitors",
              "np.returning_visitors AS prev_returning_visitors",
              f"(SELECT count(DISTINCT ip) FROM access_log WHERE pageview_flag = 1 AND timestamp >= "
              f"{int(NOW.replace(tzinfo=dt.timezone.utc).timestamp()) - 900} AND timestamp < "
              f"{int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())}) AS active_visitors"]
    rows = ", ".join(f"(SELECT * FROM s WHERE snapshot = '{n}') {a}"
                     for n, a in (("current", "c"), ("previous", "p"), ("same_time", "t")))
    return (", ".join(picks) + f" FROM {rows}, ({_nr('current', cur)}) nc, ({_nr('previous', prev)}) np")


# Yesterday is over, so its forecast is its own value.
q("overall", lambda log: ov.overall(ov.Tables.of(log), "yesterday", NOW), _overall_sql(),
  "daily", "daily_ip", "session_daily", "first_seen",
  "s AS (" + " UNION ALL ".join(_snap(n, p) for n, p in _O.items()) + ")")

_RANKED = """SELECT "key", pv, uv, CAST(round(CAST(pv AS DOUBLE) / sum(pv) OVER () * 100) AS BIGINT) AS pv_percent,
 CAST(round(CAST(uv AS DOUBLE) / sum(uv) OVER () * 100) AS BIGINT) AS uv_percent FROM (
 SELECT {key} AS "key", count(*) AS pv, count(DISTINCT ip) AS uv FROM access_log
 WHERE pageview_flag = 1 AND {time} AND {cond} GROUP BY 1 ORDER BY uv DESC, pv DESC, "key" LIMIT {n})"""


def ranked_sql(key, cond="TRUE", n=10, time=IN_MONTH):
    return _RANKED.format(key=key, cond=cond, n=n, time=time)


ENGINES = ["baidu.", "google.", "bing.", "sogou.", "360.", "so.com", "yahoo.", "duckduckgo.", "yandex."]
S_DIRECT = "(referer = '-' OR referer = '')"
S_SEARCH = "(" + " OR ".join(f"contains(lower(referer), '{e}')" for e in ENGINES) + ")"
S_INTERNAL = ("(referer LIKE 'http%://www.example.com/%' OR referer LIKE 'http%://www.example.com' "
              "OR referer LIKE 'http%://www.example.com:%')")
S_REFERER = (f"CASE WHEN {S_DIRECT} THEN '直接输入网址访问' WHEN {S_INTERNAL} THEN '站内访问' ELSE referer END")
S_KINDS = {"all": "TRUE", "search": S_SEARCH, "direct": S_DIRECT, "external": f"(NOT {S_DIRECT} AND NOT {S_SEARCH})"}
S_BEFORE = "CASE WHEN instr(domestic, '·') > 0 THEN substr(domestic, 1, instr(domestic, '·') - 1) ELSE domestic END"
S_AFTER = "CASE WHEN instr(domestic, '·') > 0 THEN substr(domestic, instr(domestic, '·') + 1) ELSE domestic END"

q("url_stats", lambda log: st.url_stats(log, MONTH), ranked_sql("url"))
q("referer_stats", lambda log: st.referer_stats(log, MONTH, OWN_DOMAINS), ranked_sql(S_REFERER))
for _kind, _cond in S_KINDS.items():
    q("referer_ip" if _kind == "all" else f"referer_ip_{_kind}",
      lambda log, kind=_kind: st.referer_ip(log, MONTH, kind), ranked_sql("ip", _cond))
q("browser_stats", lambda log: st.browser_stats(log, MONTH), ranked_sql("browser"))
q("os_stats", lambda log: st.os_stats(log, MONTH), ranked_sql("os"))
q("device_stats", lambda log: st.device_stats(log, MONTH), ranked_sql("device"))
q("location_domestic", lambda log: st.location_stats(log, MONTH, "domestic"),
  ranked_sql(S_BEFORE, "\"global\" = '中国'"))
q("location_city", lambda log: st.location_stats(log, MONTH, "city"), ranked_sql(S_AFTER, "\"global\" = '中国'"))
q("location_global", lambda log: st.location_stats(log, MONTH, "global"), ranked_sql('"global"'))

_BATCH = "\nUNION ALL\n".join(f"""SELECT '{k}' AS kind, t.ip, t.hits, CAST(t.hits AS DOUBLE) / n.total AS share,
 l.domestic, l."global", n.total AS total_hits, t.rank FROM
 (SELECT ip, count(*) AS hits, row_number() OVER (ORDER BY count(*) DESC, ip) AS rank FROM pv WHERE {c}
  GROUP BY ip QUALIFY rank <= 10) t
 JOIN (SELECT ip, domestic, "global", row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, "global", domestic)
  AS rn FROM pv WHERE {c} GROUP BY ip, domestic, "global") l ON l.ip = t.ip AND l.rn = 1,
 (SELECT count(*) AS total FROM pv WHERE {c}) n""" for k, c in S_KINDS.items())
q("referer_ip_batch", lambda log: st.referer_ip_batch(log, MONTH), _BATCH,
  f"pv AS (SELECT * FROM access_log WHERE pageview_flag = 1 AND {IN_MONTH})")

# ---- realtime ---------------------------------------------------------------------------------------------------

RT = dict(now=LATE, minutes=60)
S_RT = f"pageview_flag = 1 AND timestamp >= {_LATE - 3600} AND timestamp < {_LATE}"
q("realtime_active", lambda log: rt.realtime_active(log, **RT),
  f"SELECT count(DISTINCT ip) AS active FROM access_log WHERE {S_RT}")
q("realtime_series", lambda log: rt.realtime_series(log, **RT),
  f"""SELECT m.minute, coalesce(u.uv, 0) AS uv FROM (SELECT unnest(range({_LATE // 60 - 60}, {_LATE // 60})) AS minute)
  m LEFT JOIN (SELECT timestamp // 60 AS minute, count(DISTINCT ip) AS uv FROM access_log WHERE {S_RT}
  GROUP BY 1) u ON u.minute = m.minute""")
q("realtime_devices", lambda log: rt.realtime_devices(log, **RT),
  f"""SELECT name, CAST(coalesce(sum(n), 0) AS BIGINT) AS "count", CASE WHEN sum(sum(n)) OVER () > 0 THEN
  CAST(coalesce(sum(n), 0) AS DOUBLE) / sum(sum(n)) OVER () ELSE 0.0 END AS percent FROM (
  SELECT unnest(['PC端', '移动端', '其他']) AS name) LEFT JOIN (SELECT CASE WHEN device = '桌面设备' THEN 'PC端'
  WHEN device IN ('手机', '平板') THEN '移动端' ELSE '其他' END AS name, count(DISTINCT ip) AS n
  FROM access_log WHERE {S_RT} GROUP BY device) USING (name) GROUP BY name""")
_RT_TOP = """SELECT CASE WHEN trim(k) = '' THEN '未知' ELSE trim(k) END AS name, n AS "count",
 CAST(n AS DOUBLE) / sum(n) OVER () AS percent FROM (SELECT {key} AS k, {count} AS n FROM access_log
 WHERE {rt} GROUP BY 1 ORDER BY n DESC, k LIMIT 10)"""
for _what, _key in [("referers", S_REFERER), ("pages", "url"), ("browsers", "browser"), ("locations", S_AFTER)]:
    q("realtime_top" if _what == "referers" else f"realtime_top_{_what}",
      lambda log, what=_what: rt.realtime_top(log, what, OWN_DOMAINS, **RT),
      _RT_TOP.format(key=_key, count="count(*)" if _what == "pages" else "count(DISTINCT ip)", rt=S_RT))
q("realtime_entry_pages", lambda log: rt.realtime_entry_pages(log, **RT),
  """SELECT entry_url AS name, count(*) AS "count", CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM cut) AS percent
  FROM cut GROUP BY entry_url ORDER BY "count" DESC, name LIMIT 10""",
  f"part AS (SELECT * FROM access_log WHERE {S_RT})", sessions_of("part", "cut"))

# ---- log search -------------------------------------------------------------------------------------------------

L_COLS = ("id, timestamp, ip, method, url, status_code, bytes_sent, request_length, request_time_ms, "
          "upstream_response_time_ms, upstream_addr, host, request_id, referer, browser, os, device, domestic, "
          "\"global\", pageview_flag")
L_TIME = "strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS time"


def _logs(**kw):
    return lambda log: lg.logs(log, lg.LogQuery(**kw), NOW)


q("logs", _logs(keyword="example", time_range="last30days", status_class="2xx", exclude_internal=True,
                sort_field="bytes_sent", page=2, page_size=200),
  f"""SELECT {L_COLS}, {L_TIME} FROM access_log WHERE (contains(url, 'example') OR contains(ip, 'example')
  OR contains(referer, 'example') OR contains(domestic, 'example')) AND {IN_MONTH}
  AND status_code BETWEEN 200 AND 299 AND ip NOT LIKE '10.%' AND ip NOT LIKE '192.168.%'
  ORDER BY bytes_sent DESC, id DESC LIMIT 200 OFFSET 200""")
for _field in lg.SORT_FIELDS[1:]:
    q(f"logs_by_{_field}", _logs(sort_field=_field, sort_order="asc", page_size=300),
      f"SELECT {L_COLS}, {L_TIME} FROM access_log ORDER BY {_field}, id LIMIT 300")


def _second_page(log):
    """The page after the first, by the first one's cursor."""
    asked = lg.LogQuery(pageview_only=True, page_size=250)
    cursor = paging.next_cursor(lg.logs(log, asked, NOW), lg.order_of(asked))
    return lg.logs(log, dataclasses.replace(asked, after=cursor), NOW)


q("logs_after_cursor", _second_page, f"""SELECT {L_COLS}, {L_TIME} FROM access_log WHERE pageview_flag = 1
  ORDER BY timestamp DESC, id DESC LIMIT 250 OFFSET 250""")
q("logs_first_half", lambda log: paging.first_rows(log.select("id", "timestamp", "ip"), [("timestamp", False), ("id", True)], log.count() // 2),
  """SELECT id, timestamp, ip FROM (SELECT *, row_number() OVER (ORDER BY timestamp, id DESC) AS rn, count(*) OVER () AS n FROM access_log)
  WHERE rn <= n // 2""")
q("logs_distinct_ip", _logs(distinct_ip=True, page_size=1000),
  f"""SELECT {L_COLS}, {L_TIME} FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp DESC, id DESC)
  AS rn FROM access_log) WHERE rn = 1 ORDER BY timestamp DESC, id DESC LIMIT 1000""")
NEW_FROM, NEW_TO = 1704088800, 1704110400  # 2024-01-01 06:00 and 12:00 UTC: some visitors new, some returning
_FRESH = f"first_ts >= {NEW_FROM} AND first_ts < {NEW_TO}"
_NV_FLAG = f"CASE WHEN {_FRESH} THEN 1 ELSE 0 END AS is_new_visitor"
_NV_COND = {"new": _FRESH, "returning": f"first_ts < {NEW_FROM}", "all": "TRUE"}
for _kind, _cond in _NV_COND.items():
    q("logs_new_visitor" if _kind == "new" else f"logs_new_visitor_{_kind}",
      _logs(time_start=NEW_FROM, time_end=NEW_TO, new_visitor=_kind, page_size=1000),
      f"""SELECT {L_COLS}, {_NV_FLAG}, {L_TIME} FROM access_log LEFT JOIN first_seen USING (ip)
      WHERE timestamp >= {NEW_FROM} AND timestamp <= {NEW_TO} AND {_cond}
      ORDER BY timestamp DESC, id DESC LIMIT 1000""", "first_seen")
q("visitor_flag_rows", lambda log: lg.with_visitor_flag(log, agg.first_seen(log), NEW_FROM, NEW_TO)
  .select("id", "ip", "is_new_visitor"),
  f"SELECT id, ip, {_NV_FLAG} FROM access_log LEFT JOIN first_seen USING (ip)", "first_seen")
q("logs_count", lambda log: lg.logs_count(log, lg.LogQuery(url="/view", pageview_only=True, page_size=7), NOW),
  """SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS BIGINT) AS pages FROM access_log
  WHERE contains(url, '/view') AND pageview_flag = 1""")
q("logs_count_distinct", lambda log: lg.logs_count(log, lg.LogQuery(
    distinct_ip=True, new_visitor="returning", time_start=NEW_FROM, page_size=7), dt.datetime(2024, 1, 2)),
  f"""SELECT count(DISTINCT ip) AS total, CAST(ceil(count(DISTINCT ip) / 7.0) AS BIGINT) AS pages FROM access_log
  LEFT JOIN first_seen USING (ip) WHERE timestamp >= {NEW_FROM} AND first_ts < {NEW_FROM}""", "first_seen")
_S_COLS = ("ip, domestic, \"global\", device, browser, os, start_ts, end_ts, "
           "strftime(make_timestamp(start_ts * 1000000), '%Y-%m-%d %H:%M:%S') AS start_time, "
           "end_ts - start_ts AS duration_seconds, page_count, entry_url, exit_url")
q("session_list", lambda log: ss.session_list(log, MONTH, 1, 1000, device="手机", ip="203.0.113"),
  f"SELECT {_S_COLS} FROM cut ORDER BY start_ts DESC, ip, browser, os, device LIMIT 1000",
  f"part AS (SELECT * FROM access_log WHERE {IN_MONTH} AND contains(device, '手机') AND contains(ip, '203.0.113'))",
  sessions_of("part", "cut"))
_SUMMARY = """SELECT count(*) AS session_count, count(CASE WHEN page_count <= 1 THEN 1 END) AS bounce_count,
 CAST(count(CASE WHEN page_count <= 1 THEN 1 END) AS DOUBLE) / count(*) AS bounce_rate,
 CAST(sum(end_ts - start_ts) // count(*) AS BIGINT) AS avg_duration_seconds FROM cut"""
q("session_summary", lambda log: ss.session_summary(log, MONTH), _SUMMARY,
  f"part AS (SELECT * FROM access_log WHERE {IN_MONTH})", sessions_of("part", "cut"))

# ---- 2.8 filters ------------------------------------------------------------------------------------------------

_F_COLS = ["id", "ip", "url", "referer", "status_code"]


def f(name, condition, sql):
    q(name, lambda log: log.filter(condition()).select(*_F_COLS),
      f"SELECT {', '.join(_F_COLS)} FROM access_log WHERE {sql}")


f("f_keyword", lambda: lg.f_keyword("9"),
  "(contains(url,'9') OR contains(ip,'9') OR contains(referer,'9') OR contains(domestic,'9'))")
f("f_keyword_wildcards", lambda: lg.f_keyword("/v_ew/%", True),
  "(url LIKE '%/v_ew/%%' OR ip LIKE '%/v_ew/%%' OR referer LIKE '%/v_ew/%%' OR domestic LIKE '%/v_ew/%%')")
q("f_time_range", lambda log: lg.matching(log, lg.LogQuery(time_range="last7days"), NOW).select(*_F_COLS),
  f"SELECT {', '.join(_F_COLS)} FROM access_log WHERE timestamp >= {WEEK.start_ts} AND timestamp < {WEEK.end_ts}")
q("f_time_start", lambda log: lg.matching(log, lg.LogQuery(time_start=SPLIT), NOW).select(*_F_COLS),
  f"SELECT {', '.join(_F_COLS)} FROM access_log WHERE timestamp >= {SPLIT}")
q("f_time_end", lambda log: lg.matching(log, lg.LogQuery(time_end=SPLIT), NOW).select(*_F_COLS),
  f"SELECT {', '.join(_F_COLS)} FROM access_log WHERE timestamp <= {SPLIT}")
f("f_ip", lambda: lg.f_ip("113.1"), "contains(ip, '113.1')")
f("f_url", lambda: lg.f_url("click"), "contains(url, 'click')")
f("f_location", lambda: lg.f_location("国"), "(contains(domestic, '国') OR contains(\"global\", '国'))")
f("f_status_code", lambda: lg.f_status(404, "2xx"), "status_code = 404")
f("f_status_class", lambda: lg.f_status(0, "5XX"), "status_code >= 500 AND status_code < 600")
f("f_exclude_internal", lg.f_exclude_internal,
  r"NOT regexp_matches(ip, '^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|fc|fd|fe80:)') AND ip <> '::1'")
f("f_exclude_spider", lg.f_exclude_spider, "device <> '蜘蛛'")
f("f_exclude_foreign", lg.f_exclude_foreign, "(\"global\" = '中国' OR lower(\"global\") = 'china')")
f("f_pageview_only", lg.f_pageview_only, "pageview_flag = 1")
for _kind in ("search", "direct", "external"):
    f("f_source_kind" if _kind == "search" else f"f_source_kind_{_kind}",
      lambda kind=_kind: labels.of_source(kind), S_KINDS[_kind])
f("f_internal_referer", lambda: labels.is_internal("referer", OWN_DOMAINS), S_INTERNAL)
for _col, _text in [("device", "手"), ("browser", "rom"), ("os", "O")]:
    q(f"f_session_{_col}", lambda log, c=_col, t=_text: ss.session_filters(log, **{c: t}).select(*_F_COLS),
      f"SELECT {', '.join(_F_COLS)} FROM access_log WHERE contains({_col}, '{_text}')")
