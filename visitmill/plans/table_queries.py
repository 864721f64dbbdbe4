"""Registered queries: star schema, retention, range replacement, coverage, notifications, daily report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from visitmill.operators import aggregates as agg
from visitmill.operators import coverage as cv
from visitmill.operators import notifications as nt
from visitmill.operators import overall as ov
from visitmill.operators import report as rp
from visitmill.operators import retention as rn
from visitmill.operators import star
from visitmill.operators import stats as st
from visitmill.plans.fixture import OWN_DOMAINS, access_log
from visitmill.plans.oracle import COUNTERS, VISITOR, day, hour, over_log, sessions_of
from visitmill.plans.registry import Registry
from visitmill.plans.stat_queries import (_BATCH, L_COLS, S_REFERER, S_SEARCH, _nr, ranked_sql)

REG = Registry()


def q(name, build, body, *ctes):
    REG.add(name, lambda spark, sf: build(access_log(spark, sf)), over_log(body, *ctes) if body else None)


# ---- 2.4 star schema --------------------------------------------------------------------------------------------

def _md5(cols):
    return "md5(concat_ws(chr(31), " + ", ".join(f'"{c}"' for c in cols) + "))"


for _dim, _cols in star.DIMENSIONS.items():
    _picked = ", ".join(f'"{c}"' for c in _cols)
    q("build_dims" if _dim == "ip" else f"build_dims_{_dim}", lambda log, d=_dim: star.build_dims(log)[d],
      f"SELECT DISTINCT {_md5(_cols)} AS {_dim}_id, {_picked} FROM access_log")
_KEYS = ", ".join(f"{_md5(c)} AS {d}_id" for d, c in star.DIMENSIONS.items())
q("encode_facts", lambda log: star.encode_facts(log).drop("event_time"),
  f"""SELECT id, timestamp, method, status_code, bytes_sent, request_length, request_time_ms, upstream_response_time_ms,
  upstream_addr, host, request_id, pageview_flag, {_KEYS} FROM access_log""")
q("denormalize", lambda log: star.denormalize(star.encode_facts(log), star.build_dims(log)).drop("event_time"),
  f"SELECT {L_COLS} FROM access_log")
_OLD = 1704078000  # 2024-01-01 03:00 UTC
q("new_dim_rows", lambda log: star.new_dim_rows(
    log, "url", star.build_dims(log.filter(F.col("timestamp") < _OLD))["url"]),
  f"""SELECT DISTINCT {_md5(['url'])} AS url_id, url FROM access_log WHERE url NOT IN
  (SELECT url FROM access_log WHERE timestamp < {_OLD})""")


def _orphans(log):
    """User agents and referers still in use by the last hours."""
    late = star.encode_facts(log.filter(F.col("timestamp") >= 1706650000))
    kept = star.orphan_dims(late, star.build_dims(log))
    return (kept["ua"].select(F.lit("ua").alias("dim"), "ua_id", F.concat_ws("|", "browser", "os", "device").alias("value"))
            .unionByName(kept["url"].select(F.lit("url").alias("dim"), F.col("url_id").alias("ua_id"),
                                            F.col("url").alias("value"))).withColumnRenamed("ua_id", "key"))


q("orphan_dims", _orphans,
  f"""SELECT DISTINCT 'ua' AS dim, {_md5(['browser', 'os', 'device'])} AS "key", concat_ws('|', browser, os, device) AS value
  FROM access_log WHERE timestamp >= 1706650000 UNION ALL
  SELECT DISTINCT 'url', {_md5(['url'])}, url FROM access_log WHERE timestamp >= 1706650000""")
q("missing_columns", lambda log: star.missing_columns(log.drop(*star.TRACE_COLUMNS, "event_time")),
  f"""SELECT * REPLACE (CAST(0 AS BIGINT) AS request_length, CAST(0 AS BIGINT) AS request_time_ms,
  CAST(0 AS BIGINT) AS upstream_response_time_ms, '' AS upstream_addr, '' AS host, '' AS request_id)
  FROM (SELECT {L_COLS} FROM access_log)""")

# ---- 2.5 retention ----------------------------------------------------------------------------------------------

CUT = 1704895200 + 754  # 2024-01-10 14:12:34 UTC: inside an hour and a day


def _clean(part):
    def run(log):
        tables = rn.retention_cleanup(log, ov.Tables.of(log), agg.agg_hourly(log), agg.agg_hourly_ip(log), CUT)
        return tables[part].drop("event_time")
    return run


_KEPT = f"kept AS (SELECT * FROM access_log WHERE timestamp >= {CUT})"
_RUNS = f"runs AS (SELECT * FROM sessions WHERE start_ts >= {CUT})"
_CLEAN = {
    "facts": f"SELECT {L_COLS} FROM kept",
    "hourly": f"SELECT {hour()} AS bucket, {COUNTERS} FROM kept GROUP BY 1",
    "hourly_ip": f"SELECT DISTINCT {hour()} AS bucket, ip FROM kept WHERE pageview_flag = 1",
    "daily": f"SELECT {day()} AS day, {COUNTERS} FROM kept GROUP BY 1",
    "daily_ip": f"SELECT DISTINCT {day()} AS day, ip FROM kept WHERE pageview_flag = 1",
    "first_seen": "SELECT ip, min(timestamp) AS first_ts FROM kept WHERE pageview_flag = 1 GROUP BY ip",
    "sessions": "SELECT * FROM runs",
    "session_state": f"""SELECT {VISITOR}, max(start_ts) AS start_ts, max(end_ts) AS last_ts FROM runs GROUP BY {VISITOR}""",
    "session_daily": f"SELECT {day('start_ts')} AS day, count(*) AS sessions FROM runs GROUP BY 1",
    "entry_daily": f"SELECT {day('start_ts')} AS day, entry_url, count(*) AS \"count\" FROM runs GROUP BY 1, 2",
}
for _part, _sql in _CLEAN.items():
    q("retention_cleanup" if _part == "facts" else f"retention_cleanup_{_part}", _clean(_part), _sql,
      "sessions", _KEPT, _RUNS)



def _clean_in(part, zone, cut):
    def run(log):
        spark = log.sparkSession
        spark.conf.set("spark.sql.session.timeZone", zone)  # read when the frames below are made
        try:
            tables = rn.retention_cleanup(log, ov.Tables.of(log), agg.agg_hourly(log), agg.agg_hourly_ip(log), cut, zone)
            return tables[part]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    return run


# The cutoff falls into 2024-01-11 04:12 in China and 2024-01-11 01:42 in India, on 2024-01-10 in UTC.
CUT_IN = 1704917520
for _zone, _ahead, _name in (("Asia/Shanghai", 28800, "shanghai"), ("Asia/Kolkata", 19800, "kolkata")):
    _local = f"(timestamp + {_ahead})"
    q(f"retention_cleanup_daily_{_name}", _clean_in("daily", _zone, CUT_IN),
      f"SELECT CAST(to_timestamp({_local}) AT TIME ZONE 'UTC' AS DATE) AS day, {COUNTERS} FROM access_log WHERE timestamp >= {CUT_IN} GROUP BY 1")
    q(f"retention_cleanup_hourly_{_name}", _clean_in("hourly", _zone, CUT_IN),
      f"SELECT {_local} - {_local} % 3600 - {_ahead} AS bucket, {COUNTERS} FROM access_log WHERE timestamp >= {CUT_IN} GROUP BY 1")

R_FROM, R_TO = 1705017600, 1705363200  # 2024-01-12 to 2024-01-16


def _replaced(log):
    return rn.replace_range(log, log.withColumn("bytes_sent", F.col("bytes_sent") * 2), R_FROM, R_TO)


_NEW = (f"fresh AS (SELECT * REPLACE (CASE WHEN timestamp >= {R_FROM} AND timestamp < {R_TO} THEN bytes_sent * 2 "
        "ELSE bytes_sent END AS bytes_sent) FROM access_log)")
q("replace_range", lambda log: _replaced(log).drop("event_time"), f"SELECT {L_COLS} FROM fresh", _NEW)
q("replace_range_daily", lambda log: agg.agg_daily(_replaced(log)),
  f"SELECT {day()} AS day, {COUNTERS} FROM fresh GROUP BY 1", _NEW)

# ---- 2.11 coverage ----------------------------------------------------------------------------------------------

q("parsed_hours", cv.parsed_hours, f"SELECT DISTINCT {hour()} AS hour FROM access_log")
C_FROM, C_TO = 1704070000, 1706700000


def _coverage(log):
    """Hours with server errors stand for parsed hours, so that some are missing."""
    bounds = log.agg(F.min("timestamp").alias("log_min"), F.max("timestamp").alias("log_max"))
    return cv.hour_coverage(cv.parsed_hours(log.filter("status_code = 500")), bounds, C_FROM, C_TO)


q("hour_coverage", _coverage,
  f"""SELECT count(h) AS parsed, total, count(h) * 100 // total AS percent FROM
  (SELECT {hour(f'greatest({C_FROM}, min(timestamp))')} AS a, {hour(f'least({C_TO}, max(timestamp))')} AS b FROM access_log) e
  CROSS JOIN LATERAL (SELECT (b - a) // 3600 + 1 AS total) t
  LEFT JOIN (SELECT DISTINCT {hour()} AS h FROM access_log WHERE status_code = 500) p ON p.h BETWEEN a AND b
  GROUP BY total""")
q("parsed_range", lambda log: cv.parsed_range(log, "url"),
  "SELECT url, min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM access_log GROUP BY url")
q("parsed_range_site", lambda log: cv.site_range(cv.parsed_range(log, "url")),
  "SELECT min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM access_log")

# Each (url, status) stands for a site: page views of the middle of the month are its parsed part.
_STATUS = """SELECT url, status_code, min(timestamp) AS log_min, max(timestamp) AS log_max,
 coalesce(min(CASE WHEN timestamp BETWEEN 1704600000 AND 1705900000 THEN timestamp END), 0) AS parsed_min,
 coalesce(max(CASE WHEN timestamp BETWEEN 1704600000 AND 1705900000 AND status_code <> 301 THEN timestamp END), 0)
  AS parsed_max,
 CASE WHEN status_code = 404 THEN 1704500000 ELSE 0 END AS recent_cutoff,
 CASE WHEN status_code = 200 THEN 1704300000 WHEN status_code = 500 THEN 1705000000 ELSE 0 END AS range_start,
 CASE WHEN url LIKE '/view/%' THEN 1705500000 WHEN url LIKE '/click%' THEN 1704400000 ELSE 0 END AS range_end,
 CASE WHEN url LIKE '%/3' THEN 100 WHEN url LIKE '%/4' THEN 40 ELSE -1 END AS hour_progress
 FROM {log} GROUP BY url, status_code"""
q("pending_range", lambda log: cv.pending_range(log.sparkSession.sql(_STATUS, log=log)),
  """SELECT * EXCLUDE (rs, re, pm, bef, aft, asked, ps, pe), CASE WHEN pending AND pe >= ps THEN ps END AS pending_start,
  CASE WHEN pending AND pe >= ps THEN pe END AS pending_end, CAST(CASE WHEN NOT pending THEN NULL
   WHEN hour_progress >= 0 THEN hour_progress
   WHEN (pm = 0 AND parsed_max = 0) OR least(re, log_max) < greatest(rs, log_min) THEN 0
   ELSE greatest(0, least(100, greatest(0, least(re, log_max, greatest(a1, b1)) - greatest(rs, log_min, least(a1, b1)) + 1)
    * 100 // greatest(1, least(re, log_max) - greatest(rs, log_min) + 1))) END AS BIGINT) AS progress
  FROM (SELECT *, asked AND (bef OR aft OR (pm = 0 AND parsed_max = 0)) AS pending,
   CASE WHEN pm = 0 AND parsed_max = 0 THEN rs ELSE greatest(CASE WHEN bef THEN greatest(rs, log_min) ELSE 0 END,
    CASE WHEN aft THEN greatest(parsed_max + 1, rs) ELSE 0 END) END AS ps,
   CASE WHEN pm = 0 AND parsed_max = 0 THEN re ELSE greatest(CASE WHEN bef THEN least(re, pm - 1) ELSE 0 END,
    CASE WHEN aft THEN least(re, log_max) ELSE 0 END) END AS pe,
   CASE WHEN pm = 0 THEN parsed_max ELSE pm END AS a1, CASE WHEN parsed_max = 0 THEN pm ELSE parsed_max END AS b1
   FROM (SELECT *, pm > 0 AND rs < pm AS bef, parsed_max > 0 AND re > parsed_max AS aft,
    re >= log_min AND rs <= log_max AND hour_progress < 100 AS asked
    FROM (SELECT *, CASE WHEN range_start = 0 THEN log_min ELSE range_start END AS rs,
     CASE WHEN range_end = 0 THEN log_max ELSE range_end END AS re,
     CASE WHEN parsed_min = 0 AND recent_cutoff > 0 THEN recent_cutoff ELSE parsed_min END AS pm FROM status)))"""
  .replace("ps, pe)", "ps, pe, a1, b1)"), f"status AS ({_STATUS.format(log='access_log')})")

# ---- notifications ----------------------------------------------------------------------------------------------

# Failed requests as events; the first half of the month is the old table.
_EVENTS = """SELECT id, CASE WHEN status_code = 403 THEN '' ELSE concat('http:', CAST(status_code AS STRING), ':', url) END
 AS fingerprint, CASE WHEN status_code >= 500 THEN 'error' ELSE ' ' END AS level, 'http' AS category,
 concat('status ', CAST(status_code AS STRING)) AS title, concat(ip, ' ', url) AS message,
 CASE WHEN method = 'POST' THEN NULL ELSE concat('#', CAST(id AS STRING)) END AS metadata,
 1 + status_code % 3 AS occurrences, timestamp AS occurred_at FROM {log} WHERE status_code >= 400"""
SPLIT = 1705276800


def _notes(log, part=None):
    rows = log.sparkSession.sql(_EVENTS, log=log)
    return rows if part is None else rows.filter(F.col("occurred_at") < SPLIT if part == "old" else F.col("occurred_at") >= SPLIT)


def _empty(log):
    kinds = {"occurrences": "bigint", "created_at": "bigint", "last_occurred_at": "bigint", "read_at": "bigint"}
    return log.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in nt.COLUMNS))


def _rolled(log):
    old = nt.notification_rollup(_empty(log), _notes(log, "old")).withColumn("read_at", F.col("last_occurred_at") + 60)
    return nt.notification_rollup(old, _notes(log, "new"))


_ROLLED = f"""rolled AS (SELECT fingerprint, last(level ORDER BY occurred_at, id) AS level, 'http' AS category,
  last(title ORDER BY occurred_at, id) AS title, last(message ORDER BY occurred_at, id) AS message,
  last(metadata ORDER BY occurred_at, id) FILTER (WHERE metadata IS NOT NULL) AS metadata,
  CAST(sum(occurrences) AS BIGINT) AS occurrences, min(occurred_at) AS created_at, max(occurred_at) AS last_occurred_at,
  CASE WHEN max(occurred_at) < {SPLIT} THEN max(occurred_at) + 60 END AS read_at
  FROM (SELECT * REPLACE (CASE WHEN level = ' ' THEN 'info' ELSE level END AS level,
   CASE WHEN fingerprint = '' THEN concat('single', id) ELSE fingerprint END AS fingerprint) FROM notes)
  GROUP BY fingerprint), shown AS (SELECT * REPLACE (CASE WHEN starts_with(fingerprint, 'single') THEN '' ELSE fingerprint
  END AS fingerprint) FROM rolled)"""
_NOTES = f"notes AS ({_EVENTS.format(log='access_log')})"
q("notification_rollup", _rolled, "SELECT * FROM shown", _NOTES, _ROLLED)
q("notification_list", lambda log: nt.notification_list(
    _rolled(log).filter("fingerprint <> ''"), True, 1, 30),
  """SELECT *, (SELECT count(*) FROM shown WHERE read_at IS NULL AND fingerprint <> '') > 30 AS has_more FROM shown
  WHERE read_at IS NULL AND fingerprint <> '' ORDER BY last_occurred_at DESC, fingerprint LIMIT 30""", _NOTES, _ROLLED)
q("notification_unread", lambda log: nt.notification_unread(_rolled(log)),
  "SELECT count(*) AS unread FROM shown WHERE read_at IS NULL", _NOTES, _ROLLED)

# ---- 2.10 daily report ------------------------------------------------------------------------------------------

DAY = dt.date(2024, 1, 20)
NOW_P, BEFORE_P = rp.days(DAY)
S_NOW = f"timestamp >= {NOW_P.start_ts} AND timestamp < {NOW_P.end_ts}"
S_BEFORE_DAY = f"timestamp >= {BEFORE_P.start_ts} AND timestamp < {BEFORE_P.end_ts}"
RATE = ("CASE WHEN {p} = 0 AND {c} = 0 THEN 0.0 WHEN {p} = 0 THEN NULL "
        "ELSE CAST({c} - {p} AS DOUBLE) / CAST({p} AS DOUBLE) END")


def rate(c, p):
    return RATE.format(c=c, p=p)


q("rate_of_change", lambda log: log.select("id", rp.rate_of_change(F.col("bytes_sent") % 5, F.col("request_length") % 3)
                                           .alias("rate")),
  f"SELECT id, {rate('c', 'p')} AS rate FROM (SELECT id, bytes_sent % 5 AS c, request_length % 3 AS p FROM access_log)")


def _summary(name, cond):
    return (f"{name}_part AS (SELECT * FROM access_log WHERE {cond})", sessions_of(f"{name}_part", f"{name}_runs"),
            f"""{name}_sum AS (SELECT CAST(count(CASE WHEN page_count <= 1 THEN 1 END) AS DOUBLE) / count(*) AS bounce,
            CAST(sum(end_ts - start_ts) // count(*) AS DOUBLE) AS duration FROM {name}_runs)""",
            f"""{name} AS (SELECT (SELECT CAST(sum(pv) AS DOUBLE) FROM daily WHERE day = DATE '{DAY if name == 'c' else BEFORE_P.days[0]}') AS pv,
            (SELECT CAST(count(*) AS DOUBLE) FROM daily_ip WHERE day = DATE '{DAY if name == 'c' else BEFORE_P.days[0]}') AS uv,
            (SELECT CAST(sum(sessions) AS DOUBLE) FROM session_daily WHERE day = DATE '{DAY if name == 'c' else BEFORE_P.days[0]}') AS sessions,
            bounce, duration FROM {name}_sum)""")


_KPI = " UNION ALL ".join(f"SELECT '{m}' AS metric, c.{e} AS current, p.{e} AS previous FROM c, p" if "/" not in e else
                          f"SELECT '{m}', c.pv / c.uv, p.pv / p.uv FROM c, p" for m, e in
                          [("pv", "pv"), ("uv", "uv"), ("sessions", "sessions"), ("bounce_rate", "bounce"),
                           ("avg_duration", "duration"), ("pv_per_visitor", "pv/uv")])
q("kpi_day", lambda log: rp.kpi_day(ov.Tables.of(log), DAY),
  f"SELECT *, current - previous AS delta, {rate('current', 'previous')} AS rate FROM ({_KPI})",
  "daily", "daily_ip", "session_daily", *_summary("c", S_NOW), *_summary("p", S_BEFORE_DAY))

_REF_NOW = ranked_sql(S_REFERER, time=S_NOW, n="ALL")
_REF_BEFORE = ranked_sql(S_REFERER, time=S_BEFORE_DAY, n="ALL")
_GROUP = ("CASE WHEN \"key\" IN ('直接输入网址访问', '站内访问', '-', '') THEN 'direct' WHEN "
          + S_SEARCH.replace("referer", '"key"') + " THEN 'search' ELSE 'external' END")
q("source_groups", lambda log: rp.source_groups(st.referer_stats(log, NOW_P, OWN_DOMAINS, None),
                                                st.referer_stats(log, BEFORE_P, OWN_DOMAINS, None)),
  f"""SELECT *, current - previous AS delta, {rate('current', 'previous')} AS rate FROM (SELECT g.source,
  CAST(coalesce((SELECT sum(uv) FROM ({_REF_NOW}) WHERE {_GROUP} = g.source), 0) AS BIGINT) AS current,
  CAST(coalesce((SELECT sum(uv) FROM ({_REF_BEFORE}) WHERE {_GROUP} = g.source), 0) AS BIGINT) AS previous
  FROM (SELECT unnest(['search', 'direct', 'external']) AS source) g)""")


def top_sql(key, cond="TRUE", as_reference=False):
    past = (f"({ranked_sql(key, time=S_BEFORE_DAY)})" if as_reference else
            f"""(SELECT {key} AS "key", count(*) AS pv, count(DISTINCT ip) AS uv FROM access_log
            WHERE pageview_flag = 1 AND {S_BEFORE_DAY} GROUP BY 1)""")
    return f"""SELECT "key", pv, uv, share, ppv AS previous_pv, puv AS previous_uv, uv - puv AS delta,
    {rate('pv', 'ppv')} AS pv_rate, {rate('uv', 'puv')} AS uv_rate FROM (SELECT c."key", c.pv, c.uv, c.share,
    coalesce(p.pv, 0) AS ppv, coalesce(p.uv, 0) AS puv FROM (SELECT *, CAST(uv AS DOUBLE) / sum(uv) OVER () AS share
    FROM ({ranked_sql(key, cond, time=S_NOW)})) c LEFT JOIN {past} p ON p."key" = c."key")"""


def _ref_key():
    from visitmill.functions.labels import referer_label
    return referer_label("referer", OWN_DOMAINS)


q("top_with_previous", lambda log: rp.top_with_previous(log, DAY, "url"), top_sql("url"))
q("top_with_previous_reference", lambda log: rp.top_with_previous(log, DAY, "url", as_reference=True),
  top_sql("url", as_reference=True))
q("top_with_previous_search", lambda log: rp.top_with_previous(log, DAY, _ref_key(), search_only=True),
  top_sql(S_REFERER, S_SEARCH.replace("referer", f"({S_REFERER})")))
q("movers", lambda log: rp.movers(rp.top_with_previous(log, DAY, _ref_key())),
  f"""SELECT (SELECT "key" FROM t WHERE uv_rate IS NOT NULL ORDER BY uv_rate DESC, uv DESC, pv DESC, "key" LIMIT 1) AS rising,
  (SELECT max(uv_rate) FROM t) AS rising_rate,
  (SELECT "key" FROM t WHERE uv_rate IS NOT NULL ORDER BY uv_rate, uv DESC, pv DESC, "key" LIMIT 1) AS falling,
  (SELECT min(uv_rate) FROM t) AS falling_rate""", f"t AS ({top_sql(S_REFERER)})")
_BATCH_NOW, _BATCH_BEFORE = (_BATCH.replace("FROM pv", f"FROM {n}") for n in ("pv_now", "pv_before"))
q("source_ip_rows", lambda log: rp.source_ip_rows(st.referer_ip_batch(log, NOW_P), st.referer_ip_batch(log, BEFORE_P)),
  f"""SELECT kind, ip, hits AS current, ph AS previous, hits - ph AS delta, {rate('hits', 'ph')} AS rate, share,
  CASE WHEN "global" <> domestic THEN concat("global", ' · ', domestic) ELSE domestic END AS region FROM (
  SELECT c.*, coalesce(p.hits, 0) AS ph FROM top_now c LEFT JOIN top_before p ON p.kind = c.kind AND p.ip = c.ip)""",
  f"pv_now AS (SELECT * FROM access_log WHERE pageview_flag = 1 AND {S_NOW})",
  f"pv_before AS (SELECT * FROM access_log WHERE pageview_flag = 1 AND {S_BEFORE_DAY})",
  # Materialised, since DuckDB otherwise applies the join's filter before it ranks.
  f"top_now AS MATERIALIZED ({_BATCH_NOW})", f"top_before AS MATERIALIZED ({_BATCH_BEFORE})")
q("visitor_split", lambda log: rp.visitor_split(ov.Tables.of(log), DAY),
  f"""SELECT visitor, visitors, CASE WHEN whole > 0 THEN CAST(visitors AS DOUBLE) / whole ELSE 0.0 END AS share,
  {rate('visitors', 'past')} AS rate, CAST(c.duration AS BIGINT) AS avg_duration_seconds, c.pv / c.uv AS pv_per_visitor
  FROM (SELECT 'new' AS visitor, a.new_visitors AS visitors, b.new_visitors AS past,
   a.new_visitors + a.returning_visitors AS whole FROM ({_nr('current', NOW_P)}) a, ({_nr('previous', BEFORE_P)}) b
   UNION ALL SELECT 'returning', a.returning_visitors, b.returning_visitors, a.new_visitors + a.returning_visitors
   FROM ({_nr('current', NOW_P)}) a, ({_nr('previous', BEFORE_P)}) b), c""",
  "daily", "daily_ip", "session_daily", "first_seen", *_summary("c", S_NOW))
_DEV, _OS = ranked_sql("device", time=S_NOW, n="ALL"), ranked_sql("os", time=S_NOW, n="ALL")
q("device_cards", lambda log: rp.device_cards(st.device_stats(log, NOW_P, None), st.os_stats(log, NOW_P, None)),
  f"""SELECT (SELECT CAST(coalesce(sum(uv), 0) AS BIGINT) FROM ({_DEV}) WHERE "key" = '桌面设备') AS desktop,
  (SELECT CAST(coalesce(sum(uv), 0) AS BIGINT) FROM ({_OS}) WHERE "key" = 'iOS') AS ios,
  (SELECT CAST(coalesce(sum(uv), 0) AS BIGINT) FROM ({_OS}) WHERE "key" = 'Android') AS android""")
q("peak_trough_hour", lambda log: rp.peak_trough_hour(st.timeseries_hourly(
    agg.agg_hourly(log), agg.agg_hourly_ip(log), str(DAY), NOW_P)),
  f"""SELECT (SELECT h FROM s ORDER BY n DESC, h LIMIT 1) AS peak_hour, (SELECT h FROM s ORDER BY n, h LIMIT 1) AS trough_hour""",
  "hourly_ip", f"""s AS (SELECT CAST(i AS INT) AS h, (SELECT count(*) FROM hourly_ip
  WHERE bucket = {NOW_P.start_ts} + 3600 * i) AS n FROM (SELECT unnest(range(24)) AS i))""")
q("device_totals", lambda log: rp.device_totals(st.device_stats(log, NOW_P, None)),
  f"""SELECT device, visitors, round(CAST(visitors AS DOUBLE) / sum(visitors) OVER () * 100, 2) AS percent FROM (
  SELECT g.device, CAST(coalesce(sum(uv), 0) AS BIGINT) AS visitors FROM (SELECT unnest(['desktop', 'mobile', 'other'])
  AS device) g LEFT JOIN (SELECT uv, CASE "key" WHEN '桌面设备' THEN 'desktop' WHEN '手机' THEN 'mobile' WHEN '平板'
  THEN 'mobile' ELSE 'other' END AS device FROM ({_DEV})) USING (device) GROUP BY g.device)""")
_S4 = ["s2xx", "s3xx", "s4xx", "s5xx"]
q("status_totals", lambda log: rp.status_totals(ov.status_hits(agg.agg_daily(log), NOW_P, BEFORE_P)),
  f"""SELECT {', '.join('c.' + s for s in _S4)}, c.total, p.total AS previous_total,
  CASE WHEN p.total > 0 THEN CAST(c.total - p.total AS DOUBLE) / p.total * 100 END AS delta_percent
  FROM (SELECT *, s2xx + s3xx + s4xx + s5xx AS total FROM daily WHERE day = DATE '{DAY}') c,
  (SELECT *, s2xx + s3xx + s4xx + s5xx AS total FROM daily WHERE day = DATE '{BEFORE_P.days[0]}') p""", "daily")
