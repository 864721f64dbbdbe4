"""The stored access log: one Parquet table, partitioned by site and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitmill.plans.clock import between, day_of
from visitmill.schema import ACCESS_LOG

PARTITIONS = ["website_id", "day"]


def _laid_out(log: DataFrame) -> DataFrame:
    """One task group per (site, day), with hot groups split and small ones merged by adaptive rebalancing.

    Rows are sorted by time inside a file, so row groups carry tight time bounds.
    """
    rows = log if "day" in log.columns else log.withColumn("day", day_of("timestamp"))
    return rows.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "timestamp", "id")


def write_access_log(log: DataFrame, path: str) -> None:
    """Append records."""
    _laid_out(log).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def replace_partitions(log: DataFrame, path: str) -> None:
    """Overwrite exactly the (site, day) partitions that occur in ``log``; others stay.

    ``log`` must not be read from the same path in the same job; write it elsewhere first.
    """
    (_laid_out(log).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))


def read_access_log(spark: SparkSession, path: str, website_id: str = "", start: int = 0, end: int = 0) -> DataFrame:
    """Records of a site and time range; site and days prune partitions, times prune row groups."""
    schema = T.StructType([*ACCESS_LOG.fields, T.StructField("day", T.DateType())])
    rows = spark.read.schema(schema).parquet(path)
    if website_id:
        rows = rows.filter(F.col("website_id") == website_id)
    return between(rows, start, end)


def clear_site(spark: SparkSession, path: str, website_id: str) -> bool:
    """Delete every partition of one site."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/website_id={website_id}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.delete(folder, True))


def publish(frame: DataFrame, path: str, version: str) -> str:
    """Write a derived table as a new version next to the old ones; readers switch by name, so a lost job never
    leaves a half-written table in use."""
    target = f"{path}/version={version}"
    frame.write.mode("overwrite").parquet(target)
    return target


def scan_window(log: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Rows with ``start <= time < end``; 0 leaves a side open."""
    return between(log, start, end)


def recent_window(log: DataFrame, now: int, days: int = 7) -> DataFrame:
    """What is parsed first when a source is new."""
    return between(log, now - days * 86400)


def backfill_window(log: DataFrame, now: int, days: int = 7) -> DataFrame:
    """What is left for the backfill."""
    return between(log, 0, now - days * 86400)
