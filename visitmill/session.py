"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and splits hot ones in joins, so one setting serves both small and
# very large inputs. The shuffle partition count is an upper bound that AQE coalesces from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Methods above 8000 bytes are never compiled by the JVM; parsing then runs in smaller generated pieces instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: str = "8", memory: str = "8g", shuffle: str = "8") -> SparkSession:
    """A session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("visitmill")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    ``fallback`` is for single-machine tests only; a cluster must name its own folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback:
        return fallback
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
