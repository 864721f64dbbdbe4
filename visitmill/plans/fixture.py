"""The access log as a projection of the ``events`` test table.

The same text runs in Spark and in DuckDB; only the epoch expression differs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# The session zone is taken out again, so the epoch is that of the stored wall time read as UTC.
SPARK_EPOCH = "unix_seconds(CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP))"
DUCK_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"

NOW = dt.datetime(2024, 1, 31)
OWN_DOMAINS = ["www.example.com"]
IP_COUNT = 30

PROJECTION = """
SELECT id, timestamp, ip, method, url, status_code, bytes_sent, request_length, request_time_ms,
  upstream_response_time_ms, upstream_addr, host, request_id, referer, browser, os, device,
  CASE loc WHEN 0 THEN '广东·深圳' WHEN 1 THEN '北京' WHEN 2 THEN '浙江·杭州'
    WHEN 3 THEN '美国·加利福尼亚' WHEN 4 THEN '日本' ELSE '待解析' END AS domestic,
  CASE loc WHEN 0 THEN '中国' WHEN 1 THEN '中国' WHEN 2 THEN '中国'
    WHEN 3 THEN '美国' WHEN 4 THEN '日本' ELSE '待解析' END AS global,
  CASE WHEN status_code = 200 AND ip NOT LIKE '10.%' AND ip NOT LIKE '192.168.%'
    AND url NOT LIKE '/favicon.ico' AND url NOT LIKE '/api/%' AND url NOT LIKE '%.js'
    THEN 1 ELSE 0 END AS pageview_flag{extra}
FROM (
  SELECT event_id AS id, ts AS event_time,
    {epoch} AS timestamp,
    CASE user_id % {ips} WHEN 0 THEN '10.0.0.7' WHEN 1 THEN '192.168.1.20' WHEN 2 THEN '2001:db8::1'
      ELSE concat('203.0.113.', CAST(user_id % {ips} AS STRING)) END AS ip,
    CASE WHEN event_type IN ('signup','purchase') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN k % 10 = 0 THEN '/favicon.ico' WHEN k % 10 = 1 THEN concat('/api/', event_type)
      WHEN k % 10 = 2 THEN '/static/app.js'
      ELSE concat('/', event_type, '/', CAST(k % 7 AS STRING)) END AS url,
    CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 502 ELSE 403 END
      WHEN k % 20 = 3 THEN 301 WHEN k % 20 = 4 THEN 101 ELSE 200 END AS status_code,
    CAST(floor(value * 100) AS BIGINT) AS bytes_sent,
    CAST(100 + k AS BIGINT) AS request_length,
    CAST(floor(value * 10) AS BIGINT) AS request_time_ms,
    CAST(floor(value * 8) AS BIGINT) AS upstream_response_time_ms,
    concat('10.1.0.', CAST(k % 4 AS STRING), ':8080') AS upstream_addr,
    'www.example.com' AS host,
    concat('req-', CAST(event_id AS STRING)) AS request_id,
    CASE k % 8 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN 'https://www.google.com/search'
      WHEN 3 THEN 'https://www.baidu.com/s' WHEN 4 THEN 'https://www.example.com/home'
      ELSE concat('https://blog', CAST(k % 5 AS STRING), '.example.org/') END AS referer,
    CASE user_id % 5 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Chrome' WHEN 3 THEN 'Safari'
      ELSE '蜘蛛' END AS browser,
    CASE user_id % 5 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Android' WHEN 3 THEN 'iOS'
      ELSE '蜘蛛' END AS os,
    CASE user_id % 5 WHEN 0 THEN '桌面设备' WHEN 1 THEN '手机' WHEN 2 THEN '手机' WHEN 3 THEN '平板'
      ELSE '蜘蛛' END AS device,
    (user_id + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 6 AS loc
  FROM {source} e
) r
"""


# Two forms of the same rows. Spark takes k through a one-element array: a later filter is then not rewritten into
# many copies of the regular expression, while time bounds still reach the scan.
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
DUCK_SOURCE = f"(SELECT event_id, ts, user_id, event_type, value, {_K} AS k FROM events)"
SPARK_SOURCE = ("(SELECT event_id, ts, user_id, event_type, value, k FROM {src} "
                f"LATERAL VIEW explode(array({_K})) t AS k)")


def log_sql(ips: int = IP_COUNT) -> str:
    """The projection as DuckDB text, for oracle queries."""
    return PROJECTION.format(epoch=DUCK_EPOCH, ips=ips, source=DUCK_SOURCE, extra="").strip()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def access_log(spark: SparkSession, sf_dir: str, ips: int = IP_COUNT) -> DataFrame:
    """The access log; ``event_time`` stays beside it so that time filters reach the Parquet scan."""
    text = PROJECTION.format(epoch=SPARK_EPOCH, ips=ips, source=SPARK_SOURCE, extra=", event_time")
    return spark.sql(text, src=events(spark, sf_dir))
