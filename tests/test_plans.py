"""Physical plans: what reaches the scan, and what must never appear."""

import re

import pytest
from conftest import SF

from visitmill.operators import sessions as ss
from visitmill.operators import stats as st
from visitmill.plans import geo_queries, parse_queries, stat_queries, table_queries
from visitmill.plans.fixture import NOW, access_log
from visitmill.plans.clock import period
from visitmill.sources import tables

NAMES = [(m, n) for m in (stat_queries, parse_queries, geo_queries, table_queries) for n in m.REG.queries]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_no_nested_loops_and_no_row_python(spark, module, name):
    text = plan(module.REG.queries[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in text


def test_time_filter_and_columns_reach_the_scan(spark):
    text = plan(st.url_stats(access_log(spark, SF), period("last7days", NOW)))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", text)
    assert "value" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_stored_table_prunes_partitions(spark, log, tmp_path):
    from pyspark.sql import functions as F
    folder = str(tmp_path / "log")
    tables.write_access_log(log.withColumn("website_id", F.lit("s1")), folder)
    rows = tables.read_access_log(spark, folder, "s1", 1705276800, 1705363200).select("id", "url")
    text = plan(rows)
    assert re.search(r"PartitionFilters: \[.*website_id.*day", text)
    assert "GreaterThanOrEqual(timestamp" in text
    assert rows.count() == log.filter("timestamp >= 1705276800 AND timestamp < 1705363200").count()


def test_session_rows_are_folded_before_the_shuffle(spark):
    text = plan(ss.session_bounds(access_log(spark, SF)))
    # Read from the top of the plan to the scan: the lowest of each.
    window, exchange, partial = (text.rindex(w) for w in ("Window [", "Exchange hash", "partial_min"))
    assert window < exchange < partial
