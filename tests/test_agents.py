"""The table of agents, and what of the parse reaches a plan."""

import pytest
from test_laws import rows

from visitmill.operators import parse as ps
from visitmill.operators.agents import AgentTable
from visitmill.plans import parse_queries as pq
from visitmill.plans.fixture import NOW

FORMAT = pq.FORMATS["nginx"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_classified_once_and_unknown_ones_in_place(spark, log, tmp_path):
    lines = pq.lines_of(log, "nginx")
    whole = ps.good_rows(ps.parse_lines(lines, FORMAT, line="line", now=NOW), line="line")
    table = AgentTable(spark, str(tmp_path))
    assert table.table().count() == 0 and table.learn(spark.createDataFrame([(None,)], "agent string")) == 0
    for part in (lines.filter("id % 2 = 0"), lines.filter("id % 2 = 0").limit(3)):
        table.learn(ps.agents_of(part, FORMAT, "line"))
    first = table.table().count()
    assert 0 < first == len({r.agent for r in table.table().collect()})
    extra = spark.createDataFrame([("curl/8.0.1",), ("curl/8.0.1",), ("-",)], "agent string")
    assert table.learn(extra) == 2 and table.learn(extra) == 0
    for limit in (1 << 20, 0):  # by broadcast, and by shuffle
        again = AgentTable(spark, str(tmp_path), limit)
        assert rows(ps.good_rows(ps.parse_lines(lines, FORMAT, line="line", now=NOW, agents=again), line="line")) == rows(whole)
    empty = AgentTable(spark, str(tmp_path / "empty"))
    assert rows(ps.good_rows(ps.parse_lines(lines, FORMAT, line="line", now=NOW, agents=empty), line="line")) == rows(whole)
    table.compact()
    table.vacuum(keep=1)
    assert table.table().count() == first + 2 and len(list((tmp_path / "data").iterdir())) == 1


def test_unread_columns_are_not_computed(spark, log):
    """A filter on time holds no agent rule, no decoding of urls and no page-view rule; each step is there once."""
    lines = pq.lines_of(log, "nginx")
    made = ps.parse_lines(lines, FORMAT, line="line", now=NOW, retention_days=10)
    text = plan(ps.good_rows(made, line="line").select("id", "timestamp"))
    for word in ("spider", "url_decode", "favicon.ico$", "Trident"):
        assert word not in text
    assert text.count("gettimestamp") == 1 and text.count("stringsplitsql") <= 12
    whole = plan(ps.good_rows(made, line="line"))
    assert whole.count("gettimestamp") == 1 and whole.count("HeadlessChrome/") <= 1


def test_agents_alone_read_only_the_groups(spark, log):
    text = plan(ps.agents_of(pq.lines_of(log, "nginx"), FORMAT, "line"))
    assert "gettimestamp" not in text and "spider" not in text


@pytest.mark.parametrize("line,reason", [
    ("", "format"), ('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /x HTTP/1.1" 200 1 "-" "-"', None),
    ('1.2.3.4 - - [yesterday] "GET /x HTTP/1.1" 200 1 "-" "-"', "time"),
    ('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /\x01x HTTP/1.1" 200 1 "-" "\x01"', None),
    (', - - [01/Jan/2024:00:00:00 +0000] "GET /x HTTP/1.1" 200 1 "-" "-"', "missing field")])
def test_reasons(spark, line, reason):
    frame = spark.createDataFrame([(line, "kept", 5)], "value string, source_id string, id long")
    row = ps.parse_lines(frame, FORMAT).select("parse_error", "source_id", "id", "value").first()
    assert tuple(row) == (reason, "kept", 5, line)
