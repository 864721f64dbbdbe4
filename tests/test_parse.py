"""Line formats: published sample lines, refused input, portable rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitmill.functions import text, times
from visitmill.operators import parse as ps

NOW = dt.datetime(2026, 3, 20)
CLF = "13/Mar/2026:19:45:13 +0800"
TS = 1773402313
UA = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/144.0.0.0 Safari/537.36"

CASES = {
    "iis_query": ("iis", "2026-03-13 11:45:13 10.0.0.10 GET /index.html a=1&b=2 443 - 203.0.113.8 "
                  "Mozilla/5.0+(Windows+NT+10.0;+Win64;+x64) https://example.com/ 200 0 0 36",
                  dict(ip="203.0.113.8", method="GET", url="/index.html?a=1&b=2", status_code=200, timestamp=TS)),
    "iis_dash": ("iis-w3c", "2026-03-13 11:45:13 10.0.0.10 GET /health - 443 - 203.0.113.9 curl/8.0.1 - 204 0 0 1",
                 dict(url="/health", status_code=204, browser="curl")),
    "waf_space": ("safeline", f'192.168.1.242 - - [{CLF}] "1.111.com" "GET /csgx/api/webservice/rules?=1770383547502 '
                  f'HTTP/2.0" 200 36 "-" "{UA}" "-"',
                  dict(ip="192.168.1.242", url="/csgx/api/webservice/rules?=1770383547502", bytes_sent=36,
                       pageview_flag=0, timestamp=TS)),
    "waf_pipe": ("safeline", f'222.176.201.91 | - | {CLF} | "154.219.111.204" | "POST /api/v1/tunnel/tunnel HTTP/1.1" '
                 f'| 468 | 14862 | "-" | "{UA}"',
                 dict(method="POST", status_code=468, bytes_sent=14862, ip="222.176.201.91", host="154.219.111.204")),
    "waf_xff": ("leichi", f'120.26.17.71 | - | {CLF} | "audioshare.cn" | "GET /.safeline/static/favicon.png HTTP/1.1" | '
                f'200 | 5877 | "https://audioshare.cn/archives/category/%e6%95%99%e7%a8%8b" | "{UA}" "125.107.193.16"',
                dict(host="audioshare.cn", url="/.safeline/static/favicon.png", ip="120.26.17.71",
                     referer="https://audioshare.cn/archives/category/教程")),
    "ingress": ("nginx-ingress", f'203.0.113.10 - - [{CLF}] "GET /orders?id=42 HTTP/2.0" 200 512 "-" "curl/8.0.1" 128 '
                '0.245 [backend] [alt] 10.0.0.2:8080 512 0.200 200 req-123',
                dict(request_length=128, request_time_ms=245, upstream_response_time_ms=200,
                     upstream_addr="10.0.0.2:8080", request_id="req-123")),
    "caddy": ("caddy", '{"ts":"2026-03-13T11:45:13.5Z","request":{"client_ip":"203.0.113.7","method":"GET","uri":"/a%20b",'
              '"headers":{"USER-AGENT":["curl/8.0"],"referer":["https://x.org/"]}},"status":"200","size":7,'
              '"duration":0.0215,"duration_ms":"12ms"}',
              dict(ip="203.0.113.7", url="/a b", referer="https://x.org/", request_time_ms=12, browser="curl",
                   timestamp=TS)),
    "caddy_int_ts": ("caddy", '{"ts":1773402313,"request":{"remote_ip":"203.0.113.7","method":"GET","uri":"/"},'
                     '"status":200.9,"duration":0.5}', dict(timestamp=TS, status_code=200, request_time_ms=500)),
}


@pytest.fixture(scope="module")
def parse(spark):
    def run(made, lines, **options):
        frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "id long, value string")
        return ps.parse_lines(frame, made, now=NOW, **options)
    return run


@pytest.mark.parametrize("case", list(CASES))
def test_sample_lines(parse, case):
    kind, line, want = CASES[case]
    row = ps.good_rows(parse(ps.line_format(kind), [line])).first()
    assert row is not None
    assert {k: row[k] for k in want} == want


def test_line_format_variables(parse):
    made = ps.line_format(log_format='$remote_addr [$time_local] "$request" $status $body_bytes_sent $request_time '
                                     '$request_length $request_id')
    row = ps.good_rows(parse(made, [f'203.0.113.10 [{CLF}] "GET /health HTTP/1.1" 200 12 0.123 64 req-789'])).first()
    assert (row.request_time_ms, row.request_length, row.request_id) == (123, 64, "req-789")


def test_variable_is_captured_once():
    made = ps.pattern_from_format('$remote_addr $remote_addr "$http_referer" $nobody [$time_local] $status $uri')
    assert made.count("(?P<ip>") == 1
    assert '(?P<referer>[^"]*)' in made


@pytest.mark.parametrize("arguments", [
    dict(log_type="gopher"), dict(log_regex=r"(?P<ip>\S+) (?P<status>\d+)"), dict(log_format="no variables"),
    dict(log_regex=r"(\S+)"), dict(log_type="nginx", layout="2006/1/2 99")])
def test_refused_formats(arguments):
    with pytest.raises(ValueError):
        ps.line_format(**arguments)


def test_every_format_name():
    for name in [*ps.FORMAT_NAMES, *ps.PATTERNS]:
        assert ps.line_format(name).pattern


def test_control_character_lines(parse):
    """Lines that hold the group separator go the slower way and give the same."""
    line = f'203.0.113.10 - - [{CLF}] "GET /a\x01b HTTP/1.1" 200 5 "-" "curl/8"'
    rows = parse(ps.line_format("nginx"), [line, "\x01", "x"]).orderBy("id").collect()
    assert rows[0].url == "/a\x01b" and rows[0].parse_error is None
    assert [r.parse_error for r in rows[1:]] == ["format", "format"]


def test_native_units(parse):
    line = '[2026-03-13T11:45:13Z] "GET / HTTP/1.1" 200 - 5 6 7 8ms "203.0.113.1" "curl/8" "r" "h" "10.0.0.1:80"'
    made = ps.line_format("envoy")
    assert parse(made, [line]).first().request_time_ms == 7000
    assert parse(made, [line], native_units=True).first().request_time_ms == 7


def test_ids_do_not_depend_on_the_run(parse):
    lines = [f'203.0.113.{i} - - [{CLF}] "GET /x HTTP/1.1" 200 5 "-" "curl/8"' for i in range(9)]
    def ids():
        parsed = parse(ps.line_format("nginx"), lines).drop("id").repartition(3)
        return sorted(r.id for r in ps.good_rows(parsed).select("id").collect())
    assert ids() == ids() and len(set(ids())) == 9


def test_nul_is_removed_and_bytes_are_cut(spark):
    frame = spark.range(1).select(
        F.concat(F.lit("GE"), F.char(F.lit(0)), F.lit("T")).alias("method"),
        F.expr("cast(X'61FFFE62' as string)").alias("url"), F.repeat(F.lit("é"), 200).alias("host"))
    row = frame.withColumns(text.sanitize_columns(frame.columns, text.LIMITS)).first()
    assert (row.method, row.url) == ("GET", "a?b")
    assert len(row.host.encode()) == 254
    assert len(frame.withColumns(text.sanitize_columns(frame.columns)).first().host) == 200


@pytest.mark.parametrize("layout,pattern", [
    ("02/Jan/2006:15:04:05 -0700", "dd/MMM/yyyy:HH:mm:ss xx"), ("2006-01-02 15:04:05", "yyyy-MM-dd HH:mm:ss"),
    ("02/Jan/2006:15:04:05.000", "dd/MMM/yyyy:HH:mm:ss.SSS"), ("2006-01-02T15:04:05Z07:00", "yyyy-MM-dd'T'HH:mm:ssXXX")])
def test_layouts(layout, pattern):
    assert times.pattern_of(layout) == pattern


def test_times_do_not_depend_on_the_session_zone(spark):
    frame = spark.createDataFrame([("2026-03-13 11:45:13",)], "raw string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert frame.select(times.parse_time("raw", times.IIS_LAYOUT)).first()[0] == TS
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
