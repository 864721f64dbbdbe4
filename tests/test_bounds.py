"""Nothing is cut, clamped or refused unless asked for; days and hours follow the zone; comparisons read only their days."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from visitmill.operators import aggregates as agg
from visitmill.operators import geo, logs, overall, parse, realtime, report, sessions, stats
from visitmill.operators.notifications import notification_list
from visitmill.plans.clock import period
from visitmill.schema import ACCESS_LOG

DAY = dt.date(2024, 1, 20)
NOW = dt.datetime(2024, 1, 31)


def made(spark, rows):
    """An access log of (timestamp, ip, url, referer)."""
    plain = {f.name: F.lit(0).cast(f.dataType) if f.dataType.simpleString() in ("int", "bigint") else F.lit("x").cast(f.dataType) for f in ACCESS_LOG.fields}
    frame = spark.createDataFrame(rows, "timestamp long, ip string, url string, referer string")
    own = {c: F.col(c) for c in frame.columns} | {"id": F.monotonically_increasing_id(), "pageview_flag": F.lit(1), "status_code": F.lit(200)}
    return frame.select(*[own.get(n, c).alias(n) for n, c in plain.items()])


@pytest.fixture(scope="module")
def many(spark):
    start = 1705708800  # 2024-01-20 00:00 UTC
    return made(spark, [(start + i, f"10.0.{i // 250}.{i % 250}", "/u", f"https://ref{i % 30}.example.org/") for i in range(3000)]).cache()


def test_day_bounds_over_a_clock_change():
    for day, hours in ((dt.date(2024, 3, 31), 23), (dt.date(2024, 10, 27), 25), (dt.date(2024, 6, 1), 24)):
        start, end = agg._day_bounds(day, "Europe/Berlin")
        assert end - start == hours * 3600


def test_old_rows_and_long_urls_are_good(spark):
    line = '203.0.113.1 - - [13/Mar/2016:11:45:13 +0000] "GET /' + "a" * 3000 + ' HTTP/1.1" 200 5 "-" "curl/8"'
    rows = parse.good_rows(parse.parse_lines(spark.createDataFrame([(line,)], "value string"), parse.line_format("nginx")))
    assert len(rows.first().url) == 3001
    assert len(parse.good_rows(rows.withColumns({"value": "url", "parse_error": F.lit(None).cast("string")}), limits={"url": 2000}).first().url) == 2000


def test_all_referers_count_in_totals(many):
    when = period(str(DAY))
    groups = report.source_groups(stats.referer_stats(many, when, [], None), stats.referer_stats(many, when, [], None)).collect()
    assert {r.source: r.current for r in groups} == {"external": 3000, "direct": 0, "search": 0}
    whole = stats.ranked(many, when, "referer", None)
    assert whole.count() == 30  # all keys, no cut
    assert stats.referer_stats(many, when, []).count() == 10


def test_pages_and_windows_as_large_as_asked(spark, many):
    assert logs.logs(many, logs.LogQuery(page_size=2500)).count() == 2500
    assert sessions.session_list(many, size=2500).count() == 2500
    assert realtime.bounds(NOW, 180)[2] == 180
    assert geo.geo_recover_pending(many.withColumns({"domestic": F.lit(geo.PENDING), "global": F.lit(geo.PENDING)})).count() == 3000
    table = spark.range(700).select(F.col("id").cast("string").alias("fingerprint"), F.col("id").alias("last_occurred_at"), F.lit(None).cast("long").alias("read_at"))
    assert notification_list(table, size=600).count() == 600


def test_zone_moves_the_range_of_a_search(many):
    # 2024-01-20 00:00 to 00:50 UTC is the morning of the 20th in China and the evening of the 19th in New York.
    for zone, day, rows in (("Asia/Shanghai", "2024-01-20", 3000), ("America/New_York", "2024-01-20", 0), ("America/New_York", "2024-01-19", 3000)):
        assert logs.logs_count(many, logs.LogQuery(time_range=day, zone=zone)).first().total == rows
    at = dt.datetime(2024, 1, 20, 8, 50)
    assert realtime.realtime_active(many, at, 60, "Asia/Shanghai").first().active == 3000
    assert realtime.realtime_active(many, at, 60).first().active == 0


def test_comparisons_read_only_their_days(spark, many, tmp_path):
    """Every scan of a stored table has a day or time predicate (first-seen apart, which has one row per address)."""
    made_tables = overall.Tables.of(many)
    stored = {}
    for name in ("log", "daily", "daily_ip", "first_seen", "sessions", "session_daily", "entry_daily"):
        getattr(made_tables, name).write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    t = overall.Tables(**stored)
    now = dt.datetime(2024, 1, 20, 12)
    frames = [overall.overall(t, "today", now), overall.overall(t, "today", now, exact=True), overall.compare_snapshots(t, "last7days", now),
              report.kpi_day(t, DAY), report.visitor_split(t, DAY), stats.period_totals(t.log, {"a": period(str(DAY))})]
    for frame in frames:
        scans = re.findall(r"FileScan parquet.*", frame._jdf.queryExecution().executedPlan().toString())
        assert scans
        for scan in scans:
            if "first_ts" not in scan:
                assert re.search(r"PushedFilters: \[.*(GreaterThanOrEqual|EqualTo|LessThan)", scan), scan
