"""Registered queries: sources, sinks, exports and streams.

These write the whole log out (as lines or as a table) to the session's shared folder and read it back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from visitmill.operators import whitelist as wl
from visitmill.operators.agents import AgentTable
from visitmill.operators.parse import agents_of, dedup_stream, good_rows, line_format
from visitmill.plans.clock import epoch
from visitmill.plans.fixture import NOW, access_log
from visitmill.plans.geo_queries import CACHE, CTES, FAILS, IPS, World, _FULL, _OCTET, RULES
from visitmill.plans.oracle import COUNTERS, day, hour, over_log, sessions_of
from visitmill.plans.parse_queries import (AGENT, DUCK, FORMATS, GOOD, REQ, SPARK, _join, _s, expected_sql, lines_of, lines_sql,
                                            parsed)
from visitmill.plans.registry import Registry
from visitmill.plans.stat_queries import L_COLS, LATE
from visitmill.session import shared_dir
from visitmill.sources import exports, listing, ranges, tables, text
from visitmill.streaming import jobs
from visitmill.streaming.session_table import SessionTable
from visitmill.streaming.store import BatchStore

REG = Registry()
_LOCAL: dict[str, str] = {}
_DONE: dict[tuple, str] = {}


def scratch(spark) -> str:
    """A new folder below the session's shared one; a temporary folder only when everything runs in one process."""
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.startswith("local"):
        fallback = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="visitmill-")
        _LOCAL[app] = fallback
    else:
        fallback = None
    return f"{shared_dir(spark, fallback)}/visitmill-{uuid.uuid4().hex}"


def once(spark, sf, what, build) -> str:
    """Folder made by ``build`` for this session and data, made once."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _DONE:
        folder = scratch(spark)
        build(folder)
        _DONE[key] = folder
    return _DONE[key]


def q(name, build, body, *ctes, ips=None):
    REG.add(name, build, (over_log(body, *ctes, ips=ips) if ips else over_log(body, *ctes)) if body else None)


# ---- 2.1 sources ------------------------------------------------------------------------------------------------

def _lines_folder(spark, sf):
    """Plain and gzip files of rendered lines, in nested folders."""
    def build(folder):
        lines = lines_of(access_log(spark, sf), "nginx").select("id", F.col("line").alias("value"))
        plain, packed = lines.filter("id % 2 = 0"), lines.filter("id % 2 = 1")
        plain.select("value").repartition(4).write.text(f"{folder}/a/plain")
        packed.select("value").repartition(4).write.option("compression", "gzip").text(f"{folder}/b/c/packed")
    return once(spark, sf, "lines", build)


_LINES = f"SELECT line AS value FROM ({lines_sql('nginx', DUCK)})"
q("scan_text", lambda spark, sf: text.scan_text(spark, [f"{_lines_folder(spark, sf)}/a/plain/*.txt",
                                                        f"{_lines_folder(spark, sf)}/b/c/packed/*.gz"]).select("value"),
  _LINES)
q("scan_text_forced_gzip", lambda spark, sf: text.scan_text(
    spark, f"{_lines_folder(spark, sf)}/b/c/packed/*.gz", "gz").select("value"),
  _LINES + " WHERE id % 2 = 1")
q("scan_object_store", lambda spark, sf: text.scan_object_store(spark, _lines_folder(spark, sf), "part-*").select("value"),
  _LINES)

def _grown(spark, sf):
    """Files looked at twice: first when a third of each was written, then whole; the second look reads on where the first stopped."""
    now = ranges.list_sizes(spark, f"{_lines_folder(spark, sf)}/a/plain/*.txt").select(
        F.lit("logs").alias("source_id"), "path", "size", F.lit(0).cast("long").alias("mtime"), F.lit("").alias("etag"), F.lit(False).alias("compressed"))
    before = now.withColumn("size", F.expr("size div 3"))
    first = ranges.scan_ranges(before.select("path", F.lit(0).alias("start"), F.col("size").alias("end"), "compressed"), split=10_000)
    state = before.join(first.groupBy("path").agg(F.max("next_offset").alias("offset")), "path", "left").fillna(0, ["offset"])
    changes = listing.detect_changed_files(state.drop("compressed"), now)
    return first.unionByName(ranges.scan_changes(changes, now, split=10_000)).select("value")


q("scan_ranges", _grown, _LINES + " WHERE id % 2 = 0")


def _followed(spark, sf):
    """A stream stopped after half of the files and started again from its checkpoint when the others are there."""
    def build(folder):
        lines = spark.sql(_STREAM.replace("{clf}", SPARK["clf"]), log=access_log(spark, sf)).select("value", "id")
        for half in range(2):
            lines.filter(F.col("id") % 2 == half).select("value").write.mode("append").text(f"{folder}/in")

            def each(batch, number):
                batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={number}")
            stream = ranges.stream_growing_files(spark, f"{folder}/in/*.txt", split="20000")
            stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{once(spark, sf, 'followed', build)}/out").select("value")


# A manifest per document, naming two files.
_MANIFEST = """SELECT concat('{{"files":[{{"name":"/log/', CAST(doc_id AS STRING), '.log","bytes":', CAST(n_chars AS STRING),
 ',"mtime":', CAST(1700000000 + doc_id AS STRING), ',"etag":"', lang, '"}},{{"name":"/log/', CAST(doc_id AS STRING),
 '.log.GZ","bytes":"', CAST(n_chars AS STRING), '","mtime":"2024-01-02 03:04:05","compressed":',
 CASE WHEN n_chars % 2 = 0 THEN 'false' ELSE '"x"' END, '}},{{"bytes":1}},{{"name":" "}}]}}') AS value FROM {docs}"""
_MAP = {"items": "files", "path": "name", "size": "bytes"}


def _manifest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return listing.scan_manifest(spark.sql(_MANIFEST, docs=docs), _MAP)


REG.add("scan_manifest", _manifest,
        """SELECT concat('/log/', CAST(doc_id AS VARCHAR), '.log') AS path, CAST(n_chars AS BIGINT) AS size,
        CAST(1700000000 + doc_id AS BIGINT) AS mtime, lang AS etag, false AS compressed FROM documents UNION ALL
        SELECT concat('/log/', CAST(doc_id AS VARCHAR), '.log.GZ'), CAST(n_chars AS BIGINT), 1704164645, '',
        n_chars % 2 <> 0 FROM documents""")

_BEFORE = """SELECT source AS source_id, concat('/log/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.gz' ELSE '' END)
 AS path, CAST(n_chars AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime,
 CASE WHEN doc_id % 3 = 0 THEN 'e1' ELSE '' END AS etag, CAST(n_chars AS BIGINT) AS offset FROM {docs}
 WHERE doc_id % 11 <> 0"""
_AFTER = """SELECT source AS source_id, concat('/log/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.gz' ELSE '' END)
 AS path, CAST(CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars + 100 WHEN 2 THEN n_chars ELSE n_chars - 1 END AS BIGINT)
 AS size, CAST(CASE WHEN doc_id % 8 = 2 THEN 1700000500 ELSE 1700000000 END AS BIGINT) AS mtime,
 CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'e2' ELSE 'e1' END ELSE '' END AS etag, doc_id % 2 = 0 AS compressed
 FROM {docs} WHERE doc_id % 13 <> 0"""


def _changes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return listing.detect_changed_files(spark.sql(_BEFORE, docs=docs), spark.sql(_AFTER, docs=docs))


REG.add("detect_changed_files", _changes, f"""WITH b AS ({_BEFORE.format(docs='documents')}),
  a AS ({_AFTER.format(docs='documents')}), j AS (SELECT coalesce(a.source_id, b.source_id) AS source_id,
  coalesce(a.path, b.path) AS path, a.size AS s, b.size AS p, a.etag AS e, b.etag AS f, a.mtime AS m, b.mtime AS n, b.offset AS o,
  a.compressed AS z FROM b FULL JOIN a ON a.source_id = b.source_id AND a.path = b.path),
  c AS (SELECT *, CASE WHEN s IS NULL THEN 'removed' WHEN p IS NULL THEN 'new'
  WHEN s < p AND s > 0 AND p > 0 OR (e <> '' AND f <> '' AND e <> f AND s <= p) OR (o > s AND s > 0) THEN 'rotated'
  WHEN z AND s = p AND (e <> '' AND e = f OR e = '' AND m = n) THEN 'unchanged' WHEN z THEN 'changed'
  WHEN s > 0 AND o >= s THEN 'unchanged' ELSE 'grown' END AS state FROM j)
  SELECT source_id, path, state, CASE state WHEN 'grown' THEN o WHEN 'new' THEN 0 WHEN 'rotated' THEN 0 WHEN 'changed' THEN 0
  END AS start_offset FROM c""")

W_FROM, W_TO = 1704500000, 1705500000
q("scan_window", lambda spark, sf: tables.scan_window(access_log(spark, sf), W_FROM, W_TO).drop("event_time"),
  f"SELECT {L_COLS} FROM access_log WHERE timestamp >= {W_FROM} AND timestamp < {W_TO}")
q("scan_window_recent", lambda spark, sf: tables.recent_window(access_log(spark, sf), epoch(NOW)).select("id"),
  f"SELECT id FROM access_log WHERE timestamp >= {epoch(NOW) - 7 * 86400}")
q("scan_window_backfill", lambda spark, sf: tables.backfill_window(access_log(spark, sf), epoch(NOW)).select("id"),
  f"SELECT id FROM access_log WHERE timestamp < {epoch(NOW) - 7 * 86400}")


def _table(spark, sf):
    def build(folder):
        log = access_log(spark, sf).drop("event_time").withColumn(
            "website_id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
        tables.write_access_log(log, folder)
    return once(spark, sf, "table", build)


q("write_access_log", lambda spark, sf: tables.read_access_log(spark, _table(spark, sf), "s1", W_FROM, W_TO).drop("day"),
  f"""SELECT {L_COLS}, 's1' AS website_id FROM access_log WHERE id % 3 = 1 AND timestamp >= {W_FROM}
  AND timestamp < {W_TO}""")


def _cleared(spark, sf):
    folder = scratch(spark)
    tables.write_access_log(tables.read_access_log(spark, _table(spark, sf)), folder)
    tables.clear_site(spark, folder, "s2")
    return tables.read_access_log(spark, folder).select("website_id", "id")


q("clear_site", _cleared, "SELECT concat('s', CAST(id % 3 AS VARCHAR)) AS website_id, id FROM access_log WHERE id % 3 <> 2")


def _swapped(spark, sf):
    """One day of one site written again with doubled bytes."""
    folder = scratch(spark)
    whole = tables.read_access_log(spark, _table(spark, sf))
    tables.write_access_log(whole, folder)
    part = whole.filter("website_id = 's0' AND day = DATE'2024-01-10'").withColumn("bytes_sent", F.col("bytes_sent") * 2)
    tables.replace_partitions(part, folder)
    return tables.read_access_log(spark, folder).select("website_id", "id", "bytes_sent")


q("replace_partitions", _swapped,
  f"""SELECT concat('s', CAST(id % 3 AS VARCHAR)) AS website_id, id,
  CASE WHEN id % 3 = 0 AND {day()} = DATE '2024-01-10' THEN bytes_sent * 2 ELSE bytes_sent END AS bytes_sent FROM access_log""")

# ---- exports ----------------------------------------------------------------------------------------------------

_EXPORT = """SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS "time", ip,
 CASE WHEN domestic = '' THEN "global" ELSE domestic END AS location, concat(method, ' ', url) AS request,
 CAST(status_code AS VARCHAR) AS status, CAST(bytes_sent AS VARCHAR) AS bytes,
 CASE WHEN bytes_sent < 1024 THEN printf('%.2f B', CAST(bytes_sent AS DOUBLE))
  WHEN bytes_sent < 1048576 THEN printf('%.2f KB', bytes_sent / 1024.0::DOUBLE)
  WHEN bytes_sent < 1073741824 THEN printf('%.2f MB', bytes_sent / 1048576.0::DOUBLE)
  ELSE printf('%.2f GB', bytes_sent / 1073741824.0::DOUBLE) END AS traffic,
 CAST(request_length AS VARCHAR) AS request_size,
 CASE WHEN request_time_ms <= 0 THEN '-' ELSE concat(request_time_ms, ' ms') END AS duration,
 CASE WHEN upstream_response_time_ms <= 0 THEN '-' ELSE concat(upstream_response_time_ms, ' ms') END AS upstream_duration,
 host, request_id, upstream_addr AS upstream, CASE WHEN referer = '' THEN '-' ELSE referer END AS referer, browser, os, device,
 CASE WHEN pageview_flag = 1 THEN '{yes}' ELSE '{no}' END AS pv
 FROM (SELECT * REPLACE (bytes_sent * (1 + id % 3000) AS bytes_sent) FROM access_log)"""


def _exported(spark, sf, language):
    log = access_log(spark, sf).withColumn("bytes_sent", F.col("bytes_sent") * (1 + F.col("id") % 3000))
    return exports.export_logs(log, language)


q("export_logs", lambda spark, sf: _exported(spark, sf, "zh"), _EXPORT.format(yes="是", no="否"))


def _csv(spark, sf):
    folder = scratch(spark)
    exports.write_csv(exports.with_headers(_exported(spark, sf, "en"), "en"), folder)
    return spark.read.option("header", "true").csv(folder).toDF(*exports.COLUMNS)


q("export_logs_csv", _csv, _EXPORT.format(yes="Yes", no="No"))
q("export_geo_failures", lambda spark, sf: exports.export_geo_failures(World(spark, sf).failures, "Main"),
  """SELECT 'Main' AS website, ip, reason, source, error, CAST(status_code AS VARCHAR) AS status_code,
  strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM failures""",
  f"failures AS ({FAILS})", ips=IPS)

# ---- 2.12 streams -----------------------------------------------------------------------------------------------
# The log is rendered to lines in ten files, read as a stream of three files per batch in no particular order.

_STREAM_LINE = _join("ip", "' ['", "{clf}", "' +0000] \"'", REQ, "'\" '", _s("status_code"), "' '", _s("bytes_sent"),
                     "' '", "request_id", "' \"'", "referer", "'\" \"'", AGENT, "'\"'")
_STREAM_FORMAT = line_format(log_format='$remote_addr [$time_local] "$request" $status $body_bytes_sent $request_id '
                                        '"$http_referer" "$http_user_agent"')
_STREAM = f"SELECT id, timestamp, {_STREAM_LINE} AS value FROM {{log}}"


def _stream_input(spark, sf):
    def build(folder):
        lines = spark.sql(_STREAM.replace("{clf}", SPARK["clf"]), log=access_log(spark, sf))
        junk = lines.filter("id % 100 = 0").withColumn("value", F.lit("# comment"))
        lines.unionByName(junk).repartition(10, F.xxhash64("id")).select("value").write.text(folder)
    return once(spark, sf, "stream lines", build)


def _stream_lines(spark, sf):
    return text.stream_files(spark, _stream_input(spark, sf), max_files=3)


def _numbered(records):
    return records.withColumn("id", F.substring("request_id", 5, 20).cast("long"))


def _records(spark, sf):
    return _numbered(jobs.stream_parse(_stream_lines(spark, sf), _STREAM_FORMAT, now=NOW))


def _streamed(spark, sf, what, make_batch) -> BatchStore:
    """Batches of lines, parsed with a table of user agents that grows from batch to batch."""
    def build(folder):
        each = make_batch(BatchStore(folder))
        run = jobs.parse_batch(_STREAM_FORMAT, AgentTable(spark, f"{folder}-agents"),
                               lambda records, number: each(_numbered(records), number), now=NOW)
        query = jobs.start(_stream_lines(spark, sf), run, f"{folder}-checkpoint")
        query.awaitTermination()
    return BatchStore(once(spark, sf, what, build))


def _tables(spark, sf) -> BatchStore:
    return _streamed(spark, sf, "stream tables", jobs.write_batch)


def stream(name, build, body, *ctes, ips=None):
    q(name, build, body, *ctes, **({"ips": ips} if ips else {}))


_SEEN = "access_log WHERE pageview_flag = 1"
stream("stream_parse", lambda spark, sf: _tables(spark, sf).parts(spark, "facts").select(
    "id", "timestamp", "ip", "method", "url", "status_code", "bytes_sent", "referer", "browser", "os", "device", "pageview_flag"),
       """SELECT id, timestamp, ip, method, url, status_code, bytes_sent, referer, browser, os, device, pageview_flag
       FROM access_log""")
for _t, _sql in [("hourly", f"SELECT {hour()} AS bucket, {COUNTERS} FROM access_log GROUP BY 1"),
                 ("daily", f"SELECT {day()} AS day, {COUNTERS} FROM access_log GROUP BY 1"),
                 ("first_seen", f"SELECT ip, min(timestamp) AS first_ts FROM {_SEEN} GROUP BY ip")]:
    stream(f"stream_{_t}", lambda spark, sf, t=_t: jobs.table(spark, _tables(spark, sf), t), _sql)
stream("stream_unique_ip", lambda spark, sf: jobs.table(spark, _tables(spark, sf), "hourly_ip"),
       f"SELECT DISTINCT {hour()} AS bucket, ip FROM {_SEEN}")
def _agent_table(spark, sf) -> AgentTable:
    """Agents of the lines in two batches, the second one twice."""
    def build(folder):
        made, lines = AgentTable(spark, folder), lines_of(access_log(spark, sf), "nginx")
        for number in (0, 1, 1):
            made.learn(agents_of(lines.filter(F.col("id") % 2 == number), FORMATS["nginx"], "line"))
        made.compact()
    return AgentTable(spark, once(spark, sf, "agents", build))


stream("agent_table", lambda spark, sf: _agent_table(spark, sf).table(),
       f"SELECT DISTINCT {AGENT} AS agent, browser, os, device FROM access_log WHERE {GOOD}")
stream("parse_with_agents", lambda spark, sf: good_rows(
    parsed(access_log(spark, sf), "nginx", agents=_agent_table(spark, sf)), line="line"), expected_sql("nginx"))


def _session_table(spark, sf):
    """Batches by id, so that each brings views of all days, the second one twice; three batches reopen sessions of the first."""
    def build(folder):
        made, log = SessionTable(spark, folder, buckets=2), access_log(spark, sf)
        for number in (0, 1, 1, 2, 3):
            made.update(log.filter(F.col("id") % 4 == number), number)
        made.vacuum()
    return SessionTable(spark, once(spark, sf, "session table", build)).sessions()


stream("session_table", _session_table, "SELECT * FROM sessions", "sessions")
stream("stream_sessions", lambda spark, sf: jobs.stream_sessions(spark, _tables(spark, sf)),
       "SELECT * FROM sessions",
       "waiting AS (SELECT * REPLACE ('待解析' AS domestic, '待解析' AS \"global\") FROM access_log)",
       sessions_of("waiting"))
_LATE_TS = epoch(LATE)
stream("stream_realtime", lambda spark, sf: jobs.stream_realtime(spark, _tables(spark, sf), _LATE_TS - 3600, _LATE_TS),
       f"SELECT count(DISTINCT ip) AS active FROM {_SEEN} AND timestamp >= {_LATE_TS - 3600} AND timestamp < {_LATE_TS}")


def _compacted(spark, sf):
    """Daily counters after the first batches were folded into a base."""
    store = _tables(spark, sf)
    store.compact(spark, "daily", jobs.MERGES["daily"], 0)
    store.compact(spark, "daily", jobs.MERGES["daily"], 1)
    return jobs.table(spark, store, "daily")


stream("stream_compaction", _compacted, f"SELECT {day()} AS day, {COUNTERS} FROM access_log GROUP BY 1")


def _geo_world(spark, sf):
    """Cache and queue keyed by the addresses of the streamed log; the cache is stored, as every batch looks into it more than once."""
    def build(folder):
        log = access_log(spark, sf)
        addresses = log.groupBy("ip").agg(F.min("id").alias("k"), F.min("timestamp").alias("first_ts"),
                                          F.max("timestamp").alias("last_ts"))
        spark.sql(CACHE.replace("FROM addresses", "FROM {addresses}"), addresses=addresses).write.parquet(folder)
    cache = spark.read.parquet(once(spark, sf, "geo cache", build))
    return cache, spark.createDataFrame([], "ip string, created_at long, updated_at long")


def _geo(spark, sf):
    store = _streamed(spark, sf, "stream geo", lambda s: jobs.geo_batch(s, *_geo_world(spark, sf), now=epoch(NOW)))
    return store.parts(spark, "facts").select("id", "ip", "domestic", "global")


_CACHED = [f"addresses AS ({CTES['addresses']})", f"cache AS ({CACHE})"]
stream("stream_geo", _geo,
       """SELECT l.id, l.ip, coalesce(c.domestic, '待解析') AS domestic, coalesce(c."global", '待解析') AS "global"
       FROM access_log l LEFT JOIN (SELECT * FROM cache WHERE domestic <> '未知') c ON c.ip = l.ip""", *_CACHED)


def _geo_queue(spark, sf):
    _geo(spark, sf)
    return BatchStore(_DONE[(spark.sparkContext.applicationId, sf, "stream geo")]).get(spark, "geo_queue", jobs.merge_queue)


stream("stream_geo_queue", _geo_queue,
       f"""SELECT ip, CAST({epoch(NOW)} AS BIGINT) AS created_at, CAST({epoch(NOW)} AS BIGINT) AS updated_at FROM addresses
       WHERE ip NOT IN (SELECT ip FROM cache WHERE domestic <> '未知')""", *_CACHED)

_ADDRESS_RULES = wl.Whitelist(RULES.ips)


def _hits(spark, sf):
    store = _streamed(spark, sf, "stream whitelist", lambda s: jobs.whitelist_batch(s, _ADDRESS_RULES, "a1b2", "Main"))
    return store.get(spark, "whitelist_hits", jobs.merge_hits).select("rule_type", "rule_value", "ip", "occurrences", "timestamp")


stream("stream_whitelist", _hits,
       f"""SELECT split_part(r, '|', 1) AS rule_type, split_part(r, '|', 2) AS rule_value, ip,
       count(*) AS occurrences, min(timestamp) AS timestamp FROM (SELECT *, {_FULL} AS r FROM
       (SELECT *, {_OCTET} AS o FROM access_log)) WHERE split_part(r, '|', 1) IN ('ip', 'cidr', 'range')
       GROUP BY ALL""")


def _to_table(stream_df, spark, mode):
    """Run a one-query stream over what is there; its whole result lands in a Parquet folder."""
    folder = scratch(spark)

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    query = (stream_df.writeStream.outputMode(mode).foreachBatch(each)
             .option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(folder)


def _windowed(spark, sf):
    """The last update of each window is its final count."""
    out = _to_table(jobs.windowed_counts(_records(spark, sf), lateness="60 days"), spark, "update")
    last = out.groupBy("window").agg(F.max_by(F.struct("pv", "traffic", "hits"), "batch_id").alias("v"))
    return last.select(F.unix_seconds("window.start").alias("bucket"), "v.pv", "v.traffic", "v.hits")


stream("stream_hourly_window", _windowed,
       f"""SELECT {hour()} AS bucket, count(CASE WHEN pageview_flag = 1 THEN 1 END) AS pv,
       CAST(coalesce(sum(CASE WHEN pageview_flag = 1 THEN bytes_sent ELSE 0 END), 0) AS BIGINT) AS traffic,
       count(*) AS hits FROM access_log GROUP BY 1""")


def _dedup(spark, sf):
    lines = text.stream_files(spark, _stream_input(spark, sf), max_files=3)
    sent = lines.select(F.lit("a1b2").alias("website_id"), F.lit("push").alias("source_id"), F.col("value").alias("line"),
                        F.lit(NOW).cast("timestamp").alias("received_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return _to_table(dedup_stream(sent.drop("n")), spark, "append").select("website_id", "source_id", "line")


stream("stream_dedup", _dedup,
       "SELECT 'a1b2' AS website_id, 'push' AS source_id, value AS line FROM (" + _STREAM.replace("{clf}", DUCK["clf"])
       .replace("{log}", "access_log") + ") UNION ALL SELECT 'a1b2', 'push', '# comment'")
q("stream_files", lambda spark, sf: _to_table(text.stream_files(spark, _stream_input(spark, sf), max_files=3), spark, "append")
  .select("value"), "SELECT value FROM (" + _STREAM.replace("{clf}", DUCK["clf"]).replace("{log}", "access_log")
  + ") UNION ALL SELECT '# comment' FROM access_log WHERE id % 100 = 0")
q("stream_growing_files", _followed, "SELECT value FROM (" + _STREAM.replace("{clf}", DUCK["clf"]).replace("{log}", "access_log") + ")")
