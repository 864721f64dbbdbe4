"""Raw log lines from files."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitmill.sources import ranges

LINES_PER_BATCH = 50_000


def scan_text(spark: SparkSession, path: str | list[str], compression: str = "auto", **options) -> DataFrame:
    """``(value, path)`` of files, globs or folders. ``.gz`` is unpacked by suffix.

    ``compression="gz"`` unpacks whatever the suffix says; such a file is read by one task, as any gzip file is, but
    in pieces. Plain files are split. ``none`` is for plain files only; Spark goes by the suffix, so a plain file
    must not end in ``.gz``.
    """
    if compression.strip().lower() == "gz":
        return _forced_gzip(spark, path)
    reader = spark.read.options(**options)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def scan_object_store(spark: SparkSession, prefix: str, name: str = "*", compression: str = "auto") -> DataFrame:
    """Everything below a prefix whose base name fits the glob; works for ``s3a://`` and local folders alike."""
    return scan_text(spark, prefix, compression, pathGlobFilter=name, recursiveFileLookup="true")


def _forced_gzip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Unpacked as it is read, in files that tasks can open themselves; a file of another store passes through a row, up to 2 GB."""
    first = path if isinstance(path, str) else path[0]
    if ranges.is_readable(first.split("*")[0].rsplit("/", 1)[0] + "/"):
        files = ranges.list_sizes(spark, path).select("path", F.lit(0).alias("start"), F.lit(None).alias("end"), F.lit(True).alias("compressed"))
        return ranges.scan_ranges(files).select("value", "path")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_unpack, "value string, path string")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            lines = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), "utf-8", errors="replace", newline=None)
            while piece := [line.rstrip("\n") for _, line in zip(range(LINES_PER_BATCH), lines)]:
                yield pd.DataFrame({"value": piece, "path": path})


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000, **options) -> DataFrame:
    """New files of a folder as a stream of lines; the checkpoint remembers what was read.

    A file is read once, so logs must be rotated (or uploaded whole) into the folder; ``ranges.stream_growing_files`` follows files that
    are appended to.
    """
    return (spark.readStream.option("maxFilesPerTrigger", max_files).options(**options).text(folder)
            .select("value", F.col("_metadata.file_path").alias("path")))
