"""Shared pieces of the DuckDB texts that check the registered queries."""

from __future__ import annotations

from visitmill.plans.fixture import IP_COUNT, log_sql

DAY = "CAST(make_timestamp({0} * 1000000) AS DATE)"
HOUR = "({0} // 3600) * 3600"

COUNTERS = """CAST(sum(CASE WHEN pageview_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pv,
 CAST(sum(CASE WHEN pageview_flag = 1 THEN bytes_sent ELSE 0 END) AS BIGINT) AS traffic,
 CAST(sum(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS s2xx,
 CAST(sum(CASE WHEN status_code BETWEEN 300 AND 399 THEN 1 ELSE 0 END) AS BIGINT) AS s3xx,
 CAST(sum(CASE WHEN status_code BETWEEN 400 AND 499 THEN 1 ELSE 0 END) AS BIGINT) AS s4xx,
 CAST(sum(CASE WHEN status_code BETWEEN 500 AND 599 THEN 1 ELSE 0 END) AS BIGINT) AS s5xx,
 CAST(sum(CASE WHEN status_code < 200 OR status_code >= 600 THEN 1 ELSE 0 END) AS BIGINT) AS other"""

VISITOR = "ip, browser, os, device"


def day(column: str = "timestamp") -> str:
    return DAY.format(column)


def hour(column: str = "timestamp") -> str:
    return HOUR.format(column)


def sessions_of(source: str, name: str = "sessions") -> str:
    """CTEs that sessionise ``source`` row by row."""
    return f"""{name}_o AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL
   OR timestamp - lag(timestamp) OVER w > 1800 THEN 1 ELSE 0 END AS st
  FROM {source} WHERE pageview_flag = 1 WINDOW w AS (PARTITION BY {VISITOR} ORDER BY timestamp, id)),
{name}_n AS (SELECT *, sum(st) OVER (PARTITION BY {VISITOR} ORDER BY timestamp, id
   ROWS UNBOUNDED PRECEDING) AS sno FROM {name}_o),
{name} AS (SELECT {VISITOR}, first(domestic ORDER BY timestamp, id) AS domestic,
   first("global" ORDER BY timestamp, id) AS "global", min(timestamp) AS start_ts, max(timestamp) AS end_ts,
   first(url ORDER BY timestamp, id) AS entry_url, last(url ORDER BY timestamp, id) AS exit_url,
   count(*) AS page_count FROM {name}_n GROUP BY {VISITOR}, sno)"""


TABLES = {
    "hourly": f"SELECT {hour()} AS bucket, {COUNTERS} FROM access_log GROUP BY 1",
    "hourly_ip": f"SELECT DISTINCT {hour()} AS bucket, ip FROM access_log WHERE pageview_flag = 1",
    "daily": f"SELECT {day()} AS day, {COUNTERS} FROM access_log GROUP BY 1",
    "daily_ip": f"SELECT DISTINCT {day()} AS day, ip FROM access_log WHERE pageview_flag = 1",
    "first_seen": "SELECT ip, min(timestamp) AS first_ts FROM access_log WHERE pageview_flag = 1 GROUP BY ip",
    "session_daily": f"SELECT {day('start_ts')} AS day, count(*) AS sessions FROM sessions GROUP BY 1",
    "entry_daily": f"SELECT {day('start_ts')} AS day, entry_url, count(*) AS \"count\" FROM sessions GROUP BY 1, 2",
}


def over_log(body: str, *ctes: str, ips: int = IP_COUNT) -> str:
    """``body`` over the access log and the named helper tables; other texts are taken as CTEs."""
    parts = [f"access_log AS ({log_sql(ips)})"]
    names = list(ctes)
    if any(n in ("session_daily", "entry_daily") for n in names) and "sessions" not in names:
        names.insert(0, "sessions")
    for name in names:
        if name == "sessions":
            parts.append(sessions_of("access_log"))
        elif name in TABLES:
            parts.append(f"{name} AS ({TABLES[name]})")
        else:
            parts.append(name)
    return "WITH " + ",\n".join(parts) + "\n" + body
