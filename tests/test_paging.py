"""Pages of ordered rows against a sort of all rows."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitmill.operators import geo, paging
from visitmill.operators import logs as lg
from visitmill.operators import sessions as ss
from visitmill.sources import tables

ORDER = [("a", True), ("t", False)]


def _sorted(rows):
    """NULL is the smallest value in both directions."""
    by_text = sorted(rows, key=lambda r: (r[1] is not None, r[1] or ""))
    return sorted(by_text, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)


ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-2, 2)), st.one_of(st.none(), st.sampled_from(["", "x", "xy", "é", "\U0001F600"]))),
                min_size=1, max_size=80)


@settings(max_examples=6, deadline=None)
@given(ROWS, st.data())
def test_selection_against_a_sort(spark, rows, data):
    """Ties, NULLs and texts; draws far smaller than the rows."""
    frame = spark.createDataFrame(rows, "a int, t string")
    whole, rank = _sorted(rows), data.draw(st.integers(1, len(rows)))
    found = paging.row_at(frame, ORDER, rank, drawn=3)
    assert found.values == whole[rank - 1]
    assert found.shown == whole[:rank].count(whole[rank - 1])
    assert paging.row_at(frame, ORDER, len(rows) + 1) is None


def test_following_cursors_gives_every_row_once(spark, monkeypatch):
    """Ties that reach over several pages; numbered pages below the top-k as well."""
    pick = random.Random(5)
    rows = [(pick.choice([None, 1, 1, 1, 2]), pick.choice([None, "u", "v"])) for _ in range(60)]
    frame, whole = spark.createDataFrame(rows, "a int, t string").cache(), _sorted(rows)
    got, cursor = [], None
    while True:
        shown = paging.page(frame, ORDER, size=7, after=cursor)
        page = [tuple(r) for r in shown.collect()]
        if not page:
            break
        got, cursor = got + page, paging.next_cursor(shown, ORDER, cursor)
    assert got == whole
    monkeypatch.setattr(paging, "TOP", 9)
    for number in (1, 2, 3, 9, 10):
        part = whole[(number - 1) * 7:number * 7]
        assert [tuple(r) for r in paging.page(frame, ORDER, number, 7).collect()] == part
        more = paging.page_and_more(frame, ORDER, number, 7).collect()
        assert [tuple(r)[:2] for r in more] == part and {r.has_more for r in more} <= {number * 7 < 60}
    for limit in (5, 33, 59, 60, 80):
        assert _sorted([tuple(r) for r in paging.first_rows(frame, ORDER, limit).collect()]) == whole[:limit]


def test_many_kept_entries_are_not_gathered(spark):
    """A third of the entries have one time; the kept ones stay in as many tasks as there were."""
    cache = spark.range(0, 60_000, 1, 6).selectExpr("concat('ip', id) AS ip", "IF(id % 3 = 0, 500, id % 1000) AS created_at")
    kept = geo.geo_cache_trim(cache, 40_000)
    assert "TakeOrderedAndProject" not in kept._jdf.queryExecution().executedPlan().toString()
    want = cache.orderBy(F.desc("created_at"), "ip").limit(40_000)
    assert kept.count() == 40_000 and kept.exceptAll(want).isEmpty()


def test_deep_page_of_the_log(spark, log, monkeypatch):
    whole = log.count()
    plain = [r.id for r in log.orderBy(F.desc("timestamp"), F.desc("id")).collect()]
    monkeypatch.setattr(paging, "TOP", 100)
    number = whole // 50 - 1
    deep = lg.logs(log, lg.LogQuery(page=number, page_size=50))
    assert [r.id for r in deep.collect()] == plain[(number - 1) * 50:number * 50]
    query = lg.LogQuery(page=number, page_size=50, after=paging.next_cursor(deep, lg.order_of(lg.LogQuery())))
    assert [r.id for r in lg.logs(log, query).collect()] == plain[number * 50:(number + 1) * 50]


def test_copies_of_a_line_are_all_shown(log):
    twice = log.unionByName(log.filter("id % 2 = 0"))
    got = [r.id for r in lg.logs(twice, lg.LogQuery(page_size=90)).collect()]
    assert got == [r.id for r in twice.orderBy(F.desc("timestamp"), F.desc("id")).limit(90).collect()]


def test_session_pages_follow(log):
    whole = ss.session_list(log, size=1000).collect()
    first = ss.session_list(log, size=20)
    second = ss.session_list(log, size=20, after=paging.next_cursor(first, ss.SESSION_ORDER))
    assert first.collect() + second.collect() == whole[:40]


def test_wide_rows_are_read_for_the_page_only(spark, log, tmp_path):
    """The page is chosen from three columns of the stored log; a cursor bounds that scan."""
    folder = str(tmp_path / "log")
    tables.write_access_log(log.withColumn("website_id", F.lit("s1")), folder)
    stored = tables.read_access_log(spark, folder, "s1")
    shown = lg.logs(stored, lg.LogQuery(after=paging.Cursor((1705276800, 5))))
    text = shown._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert any("url" not in s and "referer" not in s for s in schemas)
    assert "LessThanOrEqual(timestamp,1705276800)" in text
    assert [r.id for r in shown.collect()] == [r.id for r in log.filter("timestamp < 1705276800 OR timestamp = 1705276800 AND id < 5").orderBy(
        F.desc("timestamp"), F.desc("id")).limit(100).collect()]
