"""Continuous ingestion with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitmill.operators import aggregates as agg
from visitmill.operators import sessions as ss
from visitmill.operators.agents import AgentTable
from visitmill.operators.geo import geo_backfill, geo_enqueue, geo_mark_pending
from visitmill.operators.parse import LineFormat, agents_of, good_rows, parse_lines
from visitmill.operators.shared import pageviews
from visitmill.operators.whitelist import Whitelist, whitelist_hits, whitelist_match
from visitmill.plans.clock import epoch, wall_clock
from visitmill.schema import COUNTERS, SESSION_GAP, VISITOR, scope
from visitmill.streaming.store import BatchStore


def stream_parse(lines: DataFrame, made: LineFormat, line: str = "value", **options) -> DataFrame:
    """Lines to records: a stateless projection, the same as in batch."""
    return good_rows(parse_lines(lines, made, line=line, **options), line=line)


def parse_batch(made: LineFormat, agents: AgentTable, each, line: str = "value", **options):
    """A ``foreachBatch`` function over lines that hands their records to ``each``. User agents new to ``agents`` are classified
    first, each text once; lines look theirs up. A repeated batch teaches nothing new and gives the same records."""
    def run(lines: DataFrame, batch_id: int) -> None:
        agents.learn(agents_of(lines, made, line))
        each(stream_parse(lines, made, line, agents=agents, **options), batch_id)
    return run


# ---- contributions of one micro-batch ---------------------------------------------------------------------------

def minute_ip(log: DataFrame) -> DataFrame:
    return pageviews(log).select(*scope(log), F.expr("timestamp div 60").alias("minute"), "ip").distinct()


def contributions(batch: DataFrame) -> dict[str, DataFrame]:
    """What a batch of records adds to every table."""
    return {
        "hourly": agg.agg_hourly(batch), "daily": agg.agg_daily(batch),
        "hourly_ip": agg.agg_hourly_ip(batch), "daily_ip": agg.agg_daily_ip(batch),
        "minute_ip": minute_ip(batch), "first_seen": agg.first_seen(batch), "slots": ss.slot_rows(batch),
    }


def write_batch(store: BatchStore, tables: list[str] | None = None, facts: bool = True):
    """A ``foreachBatch`` function: records and their contributions, safe to repeat.

    Contributions are made from the stored facts, a few columns each; records that are not stored are kept for the time being.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if facts:
            store.put(batch, "facts", batch_id)
        rows = store.written(batch, "facts", batch_id) if facts else batch.persist()
        try:
            for name, part in contributions(rows).items():
                if tables is None or name in tables:
                    store.put(part, name, batch_id)
        finally:
            if not facts:
                rows.unpersist()
    return run


def start(stream: DataFrame, each, checkpoint: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Run over what is there and stop, or keep polling."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


# ---- merged tables ----------------------------------------------------------------------------------------------

def _summed(key: str):
    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*scope(parts, key)).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])
    return merge


def _earliest(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*scope(parts, "ip")).agg(F.min("first_ts").alias("first_ts"))


MERGES = {
    "hourly": _summed("bucket"), "daily": _summed("day"), "hourly_ip": lambda p: p.distinct(),
    "daily_ip": lambda p: p.distinct(), "minute_ip": lambda p: p.distinct(), "first_seen": _earliest,
    "slots": ss.merge_slots,
}


def table(spark: SparkSession, store: BatchStore, name: str) -> DataFrame:
    return store.get(spark, name, MERGES[name])


def stream_sessions(spark: SparkSession, store: BatchStore, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions from the slots of all batches; late and out-of-order page views fall into place."""
    return ss.sessions_of_slots(table(spark, store, "slots"), gap)


def stream_realtime(spark: SparkSession, store: BatchStore, start_ts: int, end_ts: int) -> DataFrame:
    """Exact visitors of a span of whole minutes."""
    rows = table(spark, store, "minute_ip").filter(
        (F.col("minute") >= start_ts // 60) & (F.col("minute") < end_ts // 60))
    return rows.agg(F.countDistinct("ip").alias("active"))


# ---- one-query forms, bounded by a watermark --------------------------------------------------------------------

def windowed_counts(records: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Running counters per window for ``outputMode("update")``; later rows than ``lateness`` are left out."""
    timed = records.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", lateness)
    seen = F.col("pageview_flag") == 1
    return timed.groupBy(F.window("at", width)).agg(
        F.count(F.when(seen, 1)).alias("pv"), F.sum(F.when(seen, F.col("bytes_sent")).otherwise(0)).alias("traffic"),
        F.count("*").alias("hits"))


def windowed_unique(records: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (hour, address) once."""
    timed = pageviews(records).select(F.window(F.timestamp_seconds("timestamp"), "1 hour").start.alias("at"), "ip")
    return timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["at", "ip"])


def windowed_sessions(records: DataFrame, lateness: str = "1 hour", gap: int = SESSION_GAP) -> DataFrame:
    """Closed sessions per visitor, in append mode; a session is closed once the watermark has passed it."""
    timed = pageviews(records).withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(*VISITOR, F.session_window("at", f"{gap} seconds")).agg(
        F.count("*").alias("page_count"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))


def sliding_visitors(records: DataFrame, width: str = "30 minutes", step: str = "1 minute",
                     lateness: str = "10 minutes") -> DataFrame:
    """Visitors per sliding window. Approximate, as exact distinct counts are not kept in stream state; use
    ``stream_realtime`` for the exact number."""
    timed = pageviews(records).withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width, step)).agg(F.approx_count_distinct("ip", 0.01).alias("active"))


# ---- side effects after the batch is stored ---------------------------------------------------------------------

def geo_batch(store: BatchStore, cache: DataFrame, pending: DataFrame, now: int | None = None):
    """Facts with known locations filled in, and the queue of addresses that still need one."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        moment = now if now is not None else epoch(wall_clock())
        try:
            usable = cache.filter(~((F.col("domestic") == "未知") & (F.col("global") == "未知")))
            store.put(geo_backfill(geo_mark_pending(rows), usable), "facts", batch_id)
            # The queue follows the facts, so a lookup never runs ahead of the rows it is for.
            store.put(geo_enqueue(rows, cache, pending, moment)[0], "geo_queue", batch_id)
        finally:
            rows.unpersist()
    return run


def merge_queue(parts: DataFrame) -> DataFrame:
    return parts.groupBy("ip").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def whitelist_batch(store: BatchStore, rules: Whitelist, website_id: str, site_name: str = ""):
    """Facts first, then the hits of the batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            store.put(rows, "facts", batch_id)
            store.put(whitelist_hits(whitelist_match(rows, rules), website_id, site_name), "whitelist_hits", batch_id)
        finally:
            rows.unpersist()
    return run


def merge_hits(parts: DataFrame) -> DataFrame:
    """Counts add up; the earliest hit gives the details."""
    details = [c for c in parts.columns if c not in ("fingerprint", "occurrences")]
    grouped = parts.groupBy("fingerprint").agg(
        F.sum("occurrences").alias("occurrences"), F.min_by(F.struct(*details), "timestamp").alias("_d"))
    return grouped.select("fingerprint", "_d.*", "occurrences")
