"""Schemas, labels and limits shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels stored in the tables.
PENDING = "待解析"
UNKNOWN = "未知"
BOT = "蜘蛛"
UNKNOWN_BROWSER = "未知浏览器"
UNKNOWN_OS = "未知操作系统"
PHONE = "手机"
TABLET = "平板"
DESKTOP = "桌面设备"
OTHER_DEVICE = "其他设备"
DIRECT = "直接输入网址访问"
INTERNAL = "站内访问"
CHINA = "中国"
SEP = "·"

# Time rules.
SESSION_GAP = 1800
ACTIVE_MINUTES = 15
RECENT_DAYS = 7
RETENTION_DAYS = 30
DEDUP_MINUTES = 10
GEO_COOLDOWN_HOURS = 12
GEO_BATCH = 1000
PAGE_SIZE_MAX = 1000

VISITOR = ["ip", "browser", "os", "device"]

ACCESS_LOG = T.StructType(
    [
        T.StructField("website_id", T.StringType(), False),
        T.StructField("id", T.LongType(), True),
        T.StructField("timestamp", T.LongType(), True),
        T.StructField("ip", T.StringType(), True),
        T.StructField("method", T.StringType(), True),
        T.StructField("url", T.StringType(), True),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("bytes_sent", T.LongType(), True),
        T.StructField("request_length", T.LongType(), True),
        T.StructField("request_time_ms", T.LongType(), True),
        T.StructField("upstream_response_time_ms", T.LongType(), True),
        T.StructField("upstream_addr", T.StringType(), True),
        T.StructField("host", T.StringType(), True),
        T.StructField("request_id", T.StringType(), True),
        T.StructField("referer", T.StringType(), True),
        T.StructField("browser", T.StringType(), True),
        T.StructField("os", T.StringType(), True),
        T.StructField("device", T.StringType(), True),
        T.StructField("domestic", T.StringType(), True),
        T.StructField("global", T.StringType(), True),
        T.StructField("pageview_flag", T.IntegerType(), True),
    ]
)

LOG_COLUMNS = [f.name for f in ACCESS_LOG.fields if f.name != "website_id"]
COUNTERS = ["pv", "traffic", "s2xx", "s3xx", "s4xx", "s5xx", "other"]


def scope(df, *keys: str) -> list[str]:
    """Grouping keys, preceded by ``website_id`` when the frame carries it."""
    return (["website_id"] if "website_id" in df.columns else []) + list(keys)
