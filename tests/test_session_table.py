"""Stored sessions equal the batch's, in any order of arrival, replayed, after a crash, and beside other writers."""

import pathlib

import pytest
from pyspark.sql import functions as F
from test_laws import rows

from visitmill.operators import sessions as ss
from visitmill.streaming.manifest import Conflict, Manifest
from visitmill.streaming.session_table import SessionTable


def test_batches_late_replayed_and_vacuumed(spark, log, tmp_path):
    table = SessionTable(spark, str(tmp_path), buckets=4)
    early, late = log.filter("timestamp < 1705000000"), log.filter("timestamp >= 1705000000")
    parts = [early.filter("id % 3 = 0"), late.filter("id % 2 = 0"), early.filter("id % 3 <> 0"), late.filter("id % 2 = 1"), log.filter("false")]
    for number in (1, 0, 3):
        assert table.update(parts[number], number)
    so_far = parts[1].unionByName(parts[0]).unionByName(parts[3])
    assert rows(table.sessions()) == rows(ss.sessionize(so_far))
    assert not table.update(parts[3], 3) and not table.update(parts[0], 0)
    held = table.sessions()  # a reader of this state
    assert table.update(parts[2], 2) and table.update(parts[4], 4)
    whole = rows(ss.sessionize(log))
    assert rows(table.sessions()) == whole
    table.vacuum(keep=3)
    assert rows(held) == rows(ss.sessionize(so_far))
    table.vacuum(keep=1)
    number, state = Manifest(spark, str(tmp_path)).read()
    files = {str(p.parent.relative_to(tmp_path / "data")) for p in (tmp_path / "data").rglob("*.parquet")}
    assert files == {f"{v}/{c}" for c, v in state["cells"].items()} and state["upto"] == 4 and state["batches"] == []
    assert rows(table.sessions()) == whole
    table.expire(1706000000)
    day = 1706000000 // 86400 * 86400
    assert rows(table.sessions()) == rows(ss.sessionize(log).filter(F.col("end_ts") >= day))


def test_a_batch_reads_only_cells_it_can_reach(spark, log, tmp_path):
    table = SessionTable(spark, str(tmp_path), buckets=4)
    table.update(log.filter("timestamp < 1706000000"), 0)
    _, before = table.manifest.read()
    fresh = log.filter("timestamp >= 1706000000")
    near = table.reachable(before, 1706000000, [0, 1, 2, 3])
    assert 0 < len(near) <= 2 * 4 < len(before["cells"])
    table.update(fresh, 1)
    _, after = table.manifest.read()
    assert sum(before["cells"][c] != after["cells"][c] for c in before["cells"]) <= len(near)
    assert rows(table.sessions()) == rows(ss.sessionize(log))
    plan = ss.merge_sessions(table.blocks(), ss.session_blocks(fresh))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_attempt_that_died_and_a_second_writer(spark, log, tmp_path, monkeypatch):
    table = SessionTable(spark, str(tmp_path), buckets=2)
    table.update(log.filter("id % 2 = 0"), 0)

    def dies(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(table.manifest, "commit", dies)
        with pytest.raises(OSError):
            table.update(log.filter("id % 2 = 1"), 1)
    assert rows(table.sessions()) == rows(ss.sessionize(log.filter("id % 2 = 0")))
    assert table.update(log.filter("id % 2 = 1"), 1)
    assert rows(table.sessions()) == rows(ss.sessionize(log))
    with pytest.raises(Conflict):
        table.manifest.commit(1, {})
    assert not [p for p in pathlib.Path(tmp_path, "manifest").iterdir() if p.suffix == ".tmp"]


def test_views_that_join_two_sessions_and_visitors_without_a_browser(spark):
    def views(*at):
        return spark.createDataFrame([(t, t, "1.1.1.1", None, "o", "d", f"/{t}", "x", "y", 1) for t in at],
                                     "id long, timestamp long, ip string, browser string, os string, device string, url string, "
                                     "domestic string, global string, pageview_flag int")
    old = ss.session_blocks(views(1000, 4000))
    assert old.count() == 2
    merged = ss.merge_sessions(old, ss.session_blocks(views(2500, 9000)))
    got = sorted((r.start_ts, r.end_ts, r.entry_url, r.exit_url, r.page_count) for r in ss.sessions_of_blocks(merged).collect())
    assert got == [(1000, 4000, "/1000", "/4000", 3), (9000, 9000, "/9000", "/9000", 1)]
