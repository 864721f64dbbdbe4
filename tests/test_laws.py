"""Laws that hold whatever the data, hot keys included."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitmill.operators import aggregates as agg
from visitmill.operators import overall as ov
from visitmill.operators import sessions as ss
from visitmill.operators import whitelist as wl
from visitmill.operators.ranges import dealt, match_ranges
from visitmill.operators.shared import lookup
from visitmill.plans import clock
from visitmill.plans.fixture import NOW


def rows(frame):
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=repr)


def brute_sessions(events, gap=1800):
    out, last = [], {}
    for who, ts, i, url in sorted(events):
        if who not in last or ts - last[who][1] > gap:
            last[who] = [ts, ts, url, url, 1]
            out.append((who, last[who]))
        else:
            last[who][1:2], last[who][3] = [ts], url
            last[who][4] += 1
    return sorted((w, *v) for w, v in out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(-4000, 20000)), min_size=1, max_size=60))
def test_sessions_against_a_scan(spark, points):
    """One visitor owns most rows; times cluster around the gap."""
    events = [(who, ts, i, f"/{i % 5}") for i, (who, ts) in enumerate(points)]
    frame = spark.createDataFrame(events, "ip string, timestamp long, id long, url string").selectExpr(
        "*", "'B' AS browser", "'O' AS os", "'D' AS device", "'x' AS domestic", "'y' AS global", "1 AS pageview_flag")
    got = [(r.ip, r.start_ts, r.end_ts, r.entry_url, r.exit_url, r.page_count) for r in ss.sessionize(frame).collect()]
    assert sorted(got) == brute_sessions(events)


def test_merged_halves_equal_the_whole(log):
    a, b = log.filter("id % 2 = 0"), log.filter("id % 2 = 1")
    whole = rows(agg.agg_daily(log))
    assert rows(agg.merge_additive(agg.agg_daily(a), agg.agg_daily(b), ["day"])) == whole
    assert rows(agg.merge_min(agg.first_seen(a), agg.first_seen(b), ["ip"])) == rows(agg.first_seen(log))
    assert rows(agg.merge_set(agg.agg_daily_ip(a), agg.agg_daily_ip(b))) == rows(agg.agg_daily_ip(log))
    assert rows(ss.sessions_of_slots(ss.merge_slots(ss.slot_rows(a).unionByName(ss.slot_rows(b))))) == rows(ss.sessionize(log))


def test_merge_sessions_with_interleaved_rows(log):
    """New rows before, between and after the old ones."""
    old, new = log.filter("id % 3 <> 0"), log.filter("id % 3 = 0")
    merged = ss.merge_sessions(ss.session_blocks(old), ss.session_blocks(new))
    assert rows(ss.sessions_of_blocks(merged)) == rows(ss.sessionize(log))
    twice = ss.merge_sessions(ss.session_blocks(new.filter("id % 2 = 0")), ss.session_blocks(new.filter("id % 2 = 1")))
    assert rows(ss.sessions_of_blocks(ss.merge_sessions(ss.session_blocks(old), twice))) == rows(ss.sessionize(log))


def test_session_window_gives_the_same_counts(log):
    from_runs = ss.sessionize(log).groupBy("ip", "browser", "os", "device").agg(
        F.count("*").alias("sessions"), F.sum("page_count").alias("pages"),
        F.sum(F.col("end_ts") - F.col("start_ts")).alias("total_length"))
    assert rows(ss.session_window_agg(log)) == rows(from_runs)


def test_three_ways_to_session_metrics(log):
    runs = ss.sessionize(log)
    when = clock.Period(dt.datetime(2023, 12, 1), dt.datetime(2024, 3, 1))
    tables = rows(ss.session_metrics(when, agg.agg_session_daily(runs), agg.agg_entry_daily(runs)))
    assert tables == rows(ss.session_metrics(when, sessions=runs)) == rows(ss.session_metrics(when, log=log))


def test_sites_do_not_mix(log):
    two = log.withColumn("website_id", F.concat(F.lit("s"), (F.col("id") % 2).cast("string")))
    one = log.filter("id % 2 = 1")
    for build in (agg.agg_hourly, agg.agg_daily_ip, agg.first_seen, ss.sessionize):
        assert rows(build(two).filter("website_id = 's1'").drop("website_id")) == rows(build(one))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_a_key_that_owns_most_rows(spark, how):
    big = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'gone' "
                                             "ELSE concat('k', id % 2500) END AS key")
    table = spark.range(2500).selectExpr("concat('k', id) AS key", "id * 10 AS value").unionByName(
        spark.createDataFrame([("hot", 7)], "key string, value long"))
    assert rows(lookup(big, table, "key", how)) == rows(big.join(table, "key", how))


def test_ranges_with_one_crowded_bucket(spark):
    keys = spark.range(3000).selectExpr("concat('00000000000000000000ffffcb00', lower(lpad(hex(id), 4, '0'))) AS ip_key")
    table = spark.range(0, 60).selectExpr(
        "concat('00000000000000000000ffffcb00', lower(lpad(hex(id * 50), 4, '0'))) AS lo",
        "concat('00000000000000000000ffffcb00', lower(lpad(hex(id * 50 + 39), 4, '0'))) AS hi", "cast(id as string) AS v")
    wide = spark.createDataFrame([("20010db8" + "0" * 24, "20020db8" + "f" * 24, "six")], "lo string, hi string, v string")
    more = spark.createDataFrame([("2001ffff" + "0" * 24,), ("2003" + "0" * 28,)], "ip_key string")
    got = {r.ip_key: r.v for r in match_ranges(keys.unionByName(more), table.unionByName(wide), "v").collect()}
    assert len(got) == 3002
    assert got["2001ffff" + "0" * 24] == "six" and got["2003" + "0" * 28] is None
    for i in range(3000):
        assert got[f"00000000000000000000ffffcb00{i:04x}"] == (str(i // 50) if i % 50 < 40 else None)


def _ranges_of(tree, lo=0, hi=255):
    """Nested ranges from a list of nested fractions."""
    out, at = [], lo
    for skip, length, inner in tree:
        a = at + skip
        b = min(a + length, hi)
        if a <= b:
            out += [(a, b), *_ranges_of(inner, a, b)]
            at = b + 1
    return out


TREE = st.recursive(st.just([]), lambda inner: st.lists(st.tuples(st.integers(0, 9), st.integers(0, 60), inner), max_size=4), max_leaves=12)


@settings(max_examples=8, deadline=None)
@given(TREE, st.integers(1, 9))
def test_innermost_range_against_all_ranges(spark, tree, slices):
    """Disjoint, nested, equal and one-address ranges, with a crowded address and keys that are no address."""
    spans = [(lo, hi, f"{i:04d}") for i, (lo, hi) in enumerate(_ranges_of(tree))]
    key = "20010db8" + "0" * 22 + "{:02x}"
    keys = [(i, key.format(i)) for i in range(256)] + [(1000 + i, key.format(7)) for i in range(300)] + [(2000 + i, None) for i in range(9)]
    table = spark.createDataFrame([(key.format(lo), key.format(hi), v) for lo, hi, v in spans] + [("f", "0", "empty"), (None, "f", "no")],
                                  "lo string, hi string, v string")
    got = {r.id: r.v for r in match_ranges(spark.createDataFrame(keys, "id int, ip_key string"), table, "v", slices=slices).collect()}
    assert len(got) == len(keys)
    for i, text in keys:
        inside = [(hi - lo, -int(v), v) for lo, hi, v in spans if text and key.format(lo) <= text <= key.format(hi)]
        assert got[i] == (min(inside)[2] if inside else None)


def test_ranges_that_cross_are_refused(spark):
    keys = spark.createDataFrame([("0" * 31 + "1",)], "ip_key string")
    table = spark.createDataFrame([("0" * 31 + "1", "0" * 31 + "5", "a"), ("0" * 31 + "3", "0" * 31 + "9", "b")], "lo string, hi string, v string")
    with pytest.raises(Exception, match="ranges cross at 0000"):
        match_ranges(keys, table, "v", slices=1).collect()


def test_slices_are_even_where_addresses_crowd(spark):
    """Nine tenths of the addresses in one /16 of v6, a third of those one address; ranges nest there."""
    crowd = spark.range(18000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('20010db8', repeat('0', 23), '1') ELSE concat('20010db8', "
                                          "lower(lpad(hex(xxhash64(id)), 16, '0')), repeat('0', 8)) END AS ip_key")
    rest = spark.range(2000).selectExpr("id", "concat('00000000000000000000ffff', lower(lpad(hex(hash(id)), 8, '0'))) AS ip_key")
    ranges = spark.createDataFrame([("2001" + "0" * 28, "2001" + "f" * 28, "outer"), ("20010db8" + "0" * 24, "20010db8" + "f" * 24, "inner"),
                                    ("20010db8" + "8" + "0" * 23, "20010db88" + "f" * 23, "leaf")], "lo string, hi string, v string")
    some, copies = dealt(crowd.unionByName(rest), ranges, slices=16)
    sizes = [r["count"] for r in some.groupBy("_b").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 2 * 20000 / 16
    assert copies.count() <= 3 * 16 + 3


def test_whitelist_segments_against_all_rules():
    rules = wl.Whitelist(("10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "9.255.255.0-10.0.0.9", "10.1.2.0-10.1.2.9", "::/0"))
    flat = rules.address_rules()
    for segment in rules.segments():
        for point in (segment[0], segment[1]):
            best = min(r for r in flat if r[1] <= point <= r[2])
            assert segment[2:] == (best[3], best[4])
    assert all(a[1] < b[0] for a, b in zip(rules.segments(), rules.segments()[1:]))


# ---- clock ------------------------------------------------------------------------------------------------------

def test_periods_on_a_sunday_and_over_new_year():
    sunday = dt.datetime(2024, 1, 7, 12)
    assert clock.period("week", sunday).start == dt.datetime(2024, 1, 1)
    assert clock.period("week", sunday).end == dt.datetime(2024, 1, 7, 23)
    assert clock.previous_period("month", sunday).start == dt.datetime(2023, 12, 1)
    assert clock.previous_period("month", sunday).end == dt.datetime(2023, 12, 31, 23, 59, 59)
    assert clock.previous_period("last30days", sunday).days == (dt.date(2023, 11, 9), dt.date(2023, 12, 8))
    assert clock.period("2024-02-30", sunday) == clock.period("today", sunday)


@pytest.mark.parametrize("text,want", [
    ("", 0), ("1704067200", 1704067200), ("1704067200123", 1704067200), ("2024-01-01T00:00:00Z", 1704067200),
    ("2024-01-01T08:00:00+08:00", 1704067200), ("2024-01-01 00:00", 1704067200), ("2024-01-01T00:00", 1704067200)])
def test_time_texts(text, want):
    assert clock.parse_time_filter(text) == want


@pytest.mark.parametrize("text", ["noon", "2024/01/01", "2024-01-01"])
def test_refused_time_texts(text):
    with pytest.raises(ValueError):
        clock.parse_time_filter(text)


def test_range_intersection():
    low, high = clock.query_range("last7days", 1706300000, 1706400000, NOW)
    assert (low, high) == (1706300000, 1706400000)
    assert clock.query_range("", 5, 0) == (5, 0)


# ---- forecast ---------------------------------------------------------------------------------------------------

def test_forecast_parts():
    noon = dt.datetime(2024, 1, 20, 12)
    ranges, facts = ov.compare_ranges("today", noon)
    assert facts["weight"] == 0.7 and facts["window"] == 7200.0
    assert ranges["same_time"].end == dt.datetime(2024, 1, 19, 12)
    assert ov.compare_ranges("today", dt.datetime(2024, 1, 20, 0, 20))[1]["window"] == 0.0
    assert ov.compare_ranges("last30days", noon)[1]["weight"] == 0.3
    assert ov.compare_ranges("yesterday", noon)[1]["progress"] == 1.0


def test_forecast_numbers(spark):
    noon = dt.datetime(2024, 1, 20, 12)
    _, facts = ov.compare_ranges("today", noon)
    frame = spark.createDataFrame([(100, 40, 30, 20, 10, 5)],
                                  "current_pv long, current_uv long, current_sessions long, window_pv long, "
                                  "window_uv long, window_sessions long")
    progress = 100 * (1 / (43200 / 86399))
    scaled = round(progress)
    rated = round(scaled + 20 / 7200 * 43199)
    assert frame.select(ov.forecast_column("pv", facts)).first()[0] == round(rated * 0.7 + scaled * (1 - 0.7))
    quiet = frame.selectExpr("current_pv", "0 AS window_pv", "0 AS window_uv", "0 AS window_sessions")
    assert quiet.select(ov.forecast_column("pv", facts)).first()[0] == scaled


def test_exact_snapshots_use_times(log):
    t = ov.Tables.of(log)
    noon = dt.datetime(2024, 1, 20, 12)
    exact = {r.snapshot: r for r in ov.compare_snapshots(t, "today", noon, exact=True).collect()}
    want = log.filter("pageview_flag = 1 AND timestamp >= 1705622400 AND timestamp < 1705665600").count()
    assert exact["same_time"].pv == want
