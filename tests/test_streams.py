"""Streams give what the batch gives: in any order, late, replayed, after compaction."""

import datetime as dt

from pyspark.sql import functions as F
from conftest import SF
from test_laws import rows

from visitmill.operators import aggregates as agg
from visitmill.operators import sessions as ss
from visitmill.operators.agents import AgentTable
from visitmill.plans import flow_queries
from visitmill.plans import parse_queries as pq
from visitmill.plans.fixture import NOW
from visitmill.streaming import jobs
from visitmill.streaming.store import BatchStore


def test_batches_in_any_order_and_replayed(spark, log, tmp_path):
    store = BatchStore(str(tmp_path / "store"))
    each = jobs.write_batch(store)
    parts = [log.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == i) for i in range(4)]
    for number in (3, 0, 2):
        each(parts[number], number)
    each(parts[2], 2)  # the same batch again, as after a lost driver
    each(parts[1], 1)
    assert rows(jobs.table(spark, store, "daily")) == rows(agg.agg_daily(log))
    assert rows(jobs.stream_sessions(spark, store)) == rows(ss.sessionize(log))
    store.compact(spark, "slots", ss.merge_slots, 1)
    store.compact(spark, "slots", ss.merge_slots, 2)
    store.compact(spark, "slots", ss.merge_slots, 2)
    assert rows(jobs.stream_sessions(spark, store)) == rows(ss.sessionize(log))


def test_unfinished_base_is_not_read(spark, log, tmp_path):
    store = BatchStore(str(tmp_path / "store"))
    jobs.write_batch(store, ["daily"], facts=False)(log, 0)
    torn = tmp_path / "store" / "daily_base" / "upto=0"
    torn.mkdir(parents=True)
    assert rows(jobs.table(spark, store, "daily")) == rows(agg.agg_daily(log))


def test_closed_sessions_and_sliding_visitors(spark, log, tmp_path):
    """The one-query forms: sessions closed by the watermark equal the batch ones that ended before it."""
    log.drop("website_id").repartition(2).write.parquet(str(tmp_path / "in"))
    records = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))

    def run(frame, mode, name):
        out = str(tmp_path / name)

        def each(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        (frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", out + "-ck")
         .trigger(availableNow=True).start().awaitTermination())
        return spark.read.parquet(out)

    closed = run(jobs.windowed_sessions(records), "append", "sessions").select("ip", "browser", "os", "device", "start_ts",
                                                                              "end_ts", "page_count")
    whole = ss.sessionize(log).select(*closed.columns)
    got = set(map(tuple, closed.collect()))
    assert got <= set(map(tuple, whole.collect())) and len(got) > 100
    uniques = run(jobs.windowed_unique(records), "append", "unique").select(F.unix_seconds("at").alias("bucket"), "ip")
    assert rows(uniques) == rows(agg.agg_hourly_ip(log))
    sliding = run(jobs.sliding_visitors(records, lateness="60 days"), "update", "sliding")
    last = sliding.groupBy("window").agg(F.max_by("active", "batch_id").alias("active"))
    at = dt.datetime(2024, 1, 10, 12, 0)
    ts = int(at.replace(tzinfo=dt.timezone.utc).timestamp())
    exact = log.filter(f"pageview_flag = 1 AND timestamp >= {ts} AND timestamp < {ts + 1800}").select("ip").distinct().count()
    found = last.filter(F.unix_seconds("window.start") == ts).select("active").collect()
    assert (found[0][0] if found else 0) == exact


def test_geo_cache_is_made_once_for_all_batches(spark):
    """Batches look into a stored cache; none of them groups the whole log again."""
    cache, _ = flow_queries._geo_world(spark, SF)
    text = cache._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and "events.parquet" not in text
    again, _ = flow_queries._geo_world(spark, SF)
    assert again.inputFiles() == cache.inputFiles() and cache.count() > 0


def test_agents_of_a_batch_are_classified_once(spark, log, tmp_path):
    """Lines look their agent up; the table grows by new texts only, and records are those of the plain parse."""
    lines, made, got = pq.lines_of(log, "nginx"), pq.FORMATS["nginx"], []
    table = AgentTable(spark, str(tmp_path))
    run = jobs.parse_batch(made, table, lambda records, number: got.append(records), "line", now=NOW)
    odd = lines.select(F.col("id") + 1_000_000, F.regexp_replace("line", '"[^"]*"$', '"curl/8.0.1"').alias("line")).limit(300)
    sizes = []
    for number, part in enumerate([lines, lines.unionByName(odd.toDF("id", "line")), lines]):
        run(part, number)
        sizes.append(table.table().count())
        assert rows(got[-1]) == rows(jobs.stream_parse(part, made, "line", now=NOW))
    assert sizes[1:] == [sizes[0] + 1] * 2 and "BroadcastHashJoin" in got[-1]._jdf.queryExecution().executedPlan().toString()


def test_streamed_queries_hand_on_looked_up_agents(spark):
    seen = []

    def make_batch(store):
        return lambda records, number: seen.append(records._jdf.queryExecution().executedPlan().toString())
    flow_queries._streamed(spark, SF, "plans of batches", make_batch)
    assert len(seen) == 4 and all("BroadcastHashJoin" in text for text in seen)


def test_contributions_are_made_from_the_stored_facts(spark, log, tmp_path, monkeypatch):
    """No batch is held in memory; what is added up is what was stored."""
    seen, made = [], jobs.contributions
    monkeypatch.setattr(jobs, "contributions", lambda rows: seen.append(rows) or made(rows))
    batch = log.filter("id % 2 = 0")
    jobs.write_batch(BatchStore(str(tmp_path / "store")))(batch, 7)
    assert not batch.is_cached and all("/store/facts/batch_id=7/" in name for name in seen[0].inputFiles())
    assert rows(seen[0]) == rows(batch)
