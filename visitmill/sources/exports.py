"""Display tables and their CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names of the export, and the page-view words.
HEADERS = {
    "en": ["Time", "IP", "Location", "Request", "Status", "Bytes (Raw)", "Traffic", "Request Size", "Duration",
           "Upstream Duration", "Host", "Request ID", "Upstream", "Referer", "Browser", "OS", "Device", "PV"],
    "zh": ["时间", "IP", "位置", "请求", "状态码", "流量(字节)", "流量(可读)", "请求大小", "请求耗时", "上游耗时", "Host",
           "请求ID", "上游地址", "来源", "浏览器", "系统", "设备", "PV"],
}
YES_NO = {"en": ("Yes", "No"), "zh": ("是", "否")}
COLUMNS = ["time", "ip", "location", "request", "status", "bytes", "traffic", "request_size", "duration",
           "upstream_duration", "host", "request_id", "upstream", "referer", "browser", "os", "device", "pv"]


def human_bytes(count: Column | str) -> Column:
    """``1.50 KB``: two decimals, steps of 1024, up to TB."""
    count = F.col(count) if isinstance(count, str) else count
    out = None
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        # Ties go to the even digit.
        text = F.format_string("%.2f " + unit, F.bround(count.cast("double") / float(1024 ** power), 2))
        out = text if out is None else F.when(count < 1024 ** (power + 1), text).otherwise(out)
    return out


def milliseconds(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value <= 0, "-").otherwise(F.concat(value.cast("string"), F.lit(" ms")))


def or_dash(*values: str) -> Column:
    """The first text that is not blank."""
    picks = [F.when(F.trim(v) != "", F.trim(v)) for v in values]
    return F.coalesce(*picks, F.lit("-"))


def export_logs(log: DataFrame, language: str = "zh") -> DataFrame:
    """Log rows as 18 display texts."""
    yes, no = YES_NO[language]
    request = F.trim(F.concat_ws(" ", "method", "url"))
    return log.select(
        F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("time"), "ip",
        or_dash("domestic", "global").alias("location"),
        F.when(request == "", "-").otherwise(request).alias("request"),
        F.col("status_code").cast("string").alias("status"), F.col("bytes_sent").cast("string").alias("bytes"),
        human_bytes("bytes_sent").alias("traffic"), F.col("request_length").cast("string").alias("request_size"),
        milliseconds("request_time_ms").alias("duration"),
        milliseconds("upstream_response_time_ms").alias("upstream_duration"),
        or_dash("host").alias("host"), or_dash("request_id").alias("request_id"),
        or_dash("upstream_addr").alias("upstream"), or_dash("referer").alias("referer"),
        or_dash("browser").alias("browser"), or_dash("os").alias("os"), or_dash("device").alias("device"),
        F.when(F.col("pageview_flag") == 1, yes).otherwise(no).alias("pv"))


def with_headers(rows: DataFrame, language: str = "zh") -> DataFrame:
    return rows.toDF(*HEADERS[language])


def export_geo_failures(failures: DataFrame, label: str = "all") -> DataFrame:
    """Failures as the CSV columns, times in ISO 8601."""
    created = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return failures.select(
        F.lit(label).alias("website"), "ip", "reason", "source", "error",
        F.col("status_code").cast("string").alias("status_code"), created.alias("created_at"))


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with header; an export of any size stays a set of part files, ordered by ``order`` across them."""
    ordered = rows.orderBy(*order) if order else rows
    ordered.write.mode("overwrite").option("header", "true").csv(path)
