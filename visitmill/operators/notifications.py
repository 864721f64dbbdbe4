"""System notifications: one row per fingerprint, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.operators.paging import Cursor, page_and_more

# Texts of blank fields.
DEFAULTS = {"level": "info", "category": "system", "title": "系统通知", "message": "-"}
FIELDS = ["level", "category", "title", "message"]
COLUMNS = ["fingerprint", *FIELDS, "metadata", "occurrences", "created_at", "last_occurred_at", "read_at"]


def notification_rollup(table: DataFrame, events: DataFrame) -> DataFrame:
    """The table after new events ``(id, fingerprint, level, category, title, message, metadata, occurrences,
    occurred_at)``.

    Occurrences add up, the last event's texts win, the last metadata that is not NULL stays, and a row that
    occurred again is unread. Events without fingerprint stay rows of their own.
    """
    filled = events.withColumns({
        c: F.when(F.trim(c) == "", text).otherwise(F.trim(c)) for c, text in DEFAULTS.items()})
    filled = filled.withColumns({"fingerprint": F.trim("fingerprint"),
                                 "occurrences": F.greatest(F.col("occurrences"), F.lit(1))})
    fresh = filled.select(
        "fingerprint", *FIELDS, "metadata", "occurrences", F.col("occurred_at").alias("created_at"),
        F.col("occurred_at").alias("last_occurred_at"), F.lit(None).cast("long").alias("read_at"),
        F.col("id").alias("_order"), F.lit(True).alias("_new"))
    single = fresh.filter(F.col("fingerprint") == "").select(*COLUMNS)
    old = table.select(*COLUMNS, F.lit(-1).cast("long").alias("_order"), F.lit(False).alias("_new"))
    lone = old.filter(F.col("fingerprint") == "").select(*COLUMNS)
    both = old.unionByName(fresh).filter(F.col("fingerprint") != "")
    order = F.struct("last_occurred_at", "_order")
    grouped = both.groupBy("fingerprint").agg(
        F.max_by(F.struct(*FIELDS), order).alias("_v"),
        F.max_by("metadata", F.when(F.col("metadata").isNotNull(), order)).alias("metadata"),
        F.sum("occurrences").cast("long").alias("occurrences"),
        F.min("created_at").alias("created_at"), F.max("last_occurred_at").alias("last_occurred_at"),
        F.when(~F.max("_new"), F.max("read_at")).alias("read_at"))
    rolled = grouped.select("fingerprint", *[F.col(f"_v.{c}").alias(c) for c in FIELDS], *COLUMNS[5:])
    return rolled.unionByName(single).unionByName(lone)


def notification_list(table: DataFrame, unread_only: bool = False, number: int = 1, size: int = 20,
                      after: Cursor | None = None) -> DataFrame:
    """A page of notifications, last occurred first; ``has_more`` says whether a next page exists."""
    size = size if size > 0 else 20
    rows = table.filter(F.col("read_at").isNull()) if unread_only else table
    order = [("last_occurred_at", True), ("fingerprint", False)]
    return page_and_more(rows, order, max(number, 1), size, after)


def notification_unread(table: DataFrame) -> DataFrame:
    return table.filter(F.col("read_at").isNull()).agg(F.count("*").alias("unread"))
