"""File listings: JSON manifests and change detection between two listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of a manifest unless the source names others.
MANIFEST_FIELDS = {"items": "items", "path": "path", "size": "size", "mtime": "mtime", "etag": "etag",
                   "compressed": "compressed"}
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file, its text in ``value``."""
    return spark.read.text(path, wholetext=True)


def is_compressed(path: Column, compression: str = "auto") -> Column:
    kind = compression.strip().lower()
    if kind in ("gz", "none"):
        return F.lit(kind == "gz")
    return F.lower(path).endswith(".gz")


def scan_manifest(manifests: DataFrame, json_map: dict[str, str] | None = None, compression: str = "auto") -> DataFrame:
    """Files named by JSON manifests: path, size, mtime (epoch seconds, 0 = unknown), etag, compressed."""
    names = {**MANIFEST_FIELDS, **{k: v.strip() for k, v in (json_map or {}).items() if v and v.strip()}}
    whole = manifests.select(F.try_parse_json("value").alias("v"))
    items = whole.select(F.explode(F.try_variant_get("v", f"$['{names['items']}']", "array<variant>")).alias("i"))

    def get(field: str, kind: str) -> Column:
        return F.try_variant_get("i", f"$['{names[field]}']", kind)

    def is_kind(field: str, *kinds: str) -> Column:
        found = F.schema_of_variant(get(field, "variant"))
        return F.coalesce(found.rlike("^(" + "|".join(kinds) + ")"), F.lit(False))

    text = F.when(is_kind("path", "STRING"), get("path", "string"))
    mtime_text = get("mtime", "string")
    moment = F.when(mtime_text.rlike(TIME_TEXT), F.concat(
        mtime_text, F.when(mtime_text.contains("T"), "").otherwise("Z")).try_cast("timestamp"))
    number = is_kind("mtime", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    rows = items.select(
        text.alias("path"),
        F.coalesce(F.floor(get("size", "double")).cast("long"), F.lit(0)).alias("size"),
        F.coalesce(F.when(number, F.floor(get("mtime", "double")).cast("long"))
                   .otherwise(F.unix_seconds(moment)), F.lit(0)).alias("mtime"),
        F.coalesce(F.when(is_kind("etag", "STRING"), get("etag", "string")), F.lit("")).alias("etag"),
        F.coalesce(F.when(is_kind("compressed", "BOOLEAN"), get("compressed", "boolean")),
                   is_compressed(text, compression)).alias("compressed"))
    return rows.filter(F.trim("path") != "")


def detect_changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What to do with each file of the current listing, and from which byte on.

    ``previous`` holds (source_id, path, size, mtime, etag, offset) of the last scan. A file is *rotated* when it
    shrank, when its etag changed without growth, or when it is shorter than what was read; compressed files are read
    again whole (*changed*) unless size and etag (or time) are the same; other files continue where they stopped.
    Files that are gone are *removed*.
    """
    keys = ["source_id", "path"]
    old = previous.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("size", "mtime", "etag", "offset")])
    both = current.join(old, keys, "full_outer")
    size, o_size, o_offset = F.col("size"), F.col("o_size"), F.col("o_offset")
    other_tag = (F.col("etag") != "") & (F.col("o_etag") != "") & (F.col("etag") != F.col("o_etag"))
    rotated = (((size > 0) & (o_size > 0) & (size < o_size)) | (other_tag & (size <= o_size))
               | ((o_offset > 0) & (size > 0) & (o_offset > size)))
    same = (size == o_size) & (((F.col("etag") != "") & (F.col("etag") == F.col("o_etag")))
                               | ((F.col("etag") == "") & (F.col("mtime") == F.col("o_mtime"))))
    packed = F.col("compressed")
    state = (F.when(size.isNull(), "removed").when(o_size.isNull(), "new").when(rotated, "rotated")
             .when(packed & same, "unchanged").when(packed, "changed")
             .when((size > 0) & (o_offset >= size), "unchanged").otherwise("grown"))
    marked = both.withColumn("state", state)
    start = F.when(F.col("state") == "grown", o_offset).when(
        F.col("state").isin("new", "rotated", "changed"), 0).cast("long")
    return marked.select(*keys, "state", start.alias("start_offset"))
