"""Exact duplicates against a persistent index of text digests; DataFrame and SQL functions only.

The index is a Parquet table, bucketed and sorted by digest, one row per distinct text seen so far. A batch is reduced to one row
per digest, merged against the index by an anti-join that reads the index without shuffling it, and what is new is appended. Appending
adds a file to each bucket, so a bucket is sorted again as it is read.

Defined cases: null text counts as empty. Rows with a null doc_id take part; the smallest non-null doc_id of a group stays, null
only if the group has no other. Rows that repeat a doc_id with the same text are told apart by nothing, so all rows that carry
the kept id are kept. Other columns pass through; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitmill.llm.shared import SPACE, saved, scratch

HOT_SHARE = 1000


def digest(text: str = "text") -> F.Column:
    """SHA-256 of the text in which each run of white space is one blank."""
    plain = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), f"{SPACE}+", " ")
    # Never null, and said to be so: joins would otherwise test it first, which is to compute it twice.
    return F.coalesce(F.unhex(F.sha2(plain, 256)), F.lit(bytearray()))


class DigestIndex:
    """digest -> doc_id that stays. ``path`` is its folder; an index that is already there is opened again."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` (one row per digest) that the index lacks."""
        new = (groups.hint("merge").join(self.rows(), "digest", "left_anti").select("digest", "keep_id")
               .repartition(self.buckets, "digest").sortWithinPartitions("digest"))
        new.write.insertInto(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Append the batch's new texts to the index and return the batch with keep_id, group_size, kept and digest.

    keep_id is the document that stays: of an earlier batch if the text was known, else the smallest doc_id of this batch.
    group_size counts the rows of this batch with that text. Input columns with these names are replaced.
    """
    folder = scratch(docs.sparkSession)
    own = docs.drop("keep_id", "group_size", "kept", "digest")
    marks = own.select("doc_id", digest().alias("digest"))
    groups = saved(marks.groupBy("digest").agg(F.min("doc_id").cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups", folder)
    index.append_new(groups)
    known = groups.drop("keep_id").hint("merge").join(index.rows(), "digest")
    marked = own.withColumn("digest", digest())
    # Texts of more than 1/1000 of the rows are fewer than a thousand: their rows stay where they are, only the others are shuffled.
    total = groups.agg(F.sum("group_size").alias("n")).scalar()
    hot = F.broadcast(known.filter(F.col("group_size") * HOT_SHARE > total))
    common = marked.join(hot, "digest")
    others = marked.join(hot, "digest", "left_anti").join(known.hint("merge"), "digest")
    return common.unionByName(others).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
