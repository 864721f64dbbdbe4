"""Registered queries: line formats and the field rules of the parse job.

Lines are rendered from the whole access log by the same text in both engines and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from visitmill.functions import agents, net, pageview, text, times
from visitmill.operators import parse as ps
from visitmill.plans.clock import epoch
from visitmill.plans.fixture import NOW, access_log
from visitmill.plans.oracle import over_log
from visitmill.plans.registry import Registry

REG = Registry()
NOW_TS = epoch(NOW)

SPARK = {
    "clf": "date_format(timestamp_seconds(timestamp), 'dd/MMM/yyyy:HH:mm:ss')",
    "iso": "date_format(timestamp_seconds(timestamp), \"yyyy-MM-dd'T'HH:mm:ss\")",
    "iis": "date_format(timestamp_seconds(timestamp), 'yyyy-MM-dd HH:mm:ss')",
}
DUCK = {
    "clf": "strftime(make_timestamp(timestamp * 1000000), '%d/%b/%Y:%H:%M:%S')",
    "iso": "strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%S')",
    "iis": "strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S')",
}

AGENT = """CASE device WHEN '桌面设备' THEN
 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
 WHEN '平板' THEN
 'Mozilla/5.0 (iPad; CPU OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1'
 WHEN '手机' THEN CASE os WHEN 'iOS' THEN
 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1'
 ELSE
 'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36' END
 ELSE 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' END"""


def _s(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _join(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


REQ = _join("method", "' '", "url", "' HTTP/1.1'")
_TAIL = [_s("status_code"), "' '", _s("bytes_sent"), "' \"'", "referer", "'\" \"'", AGENT, "'\"'"]
_CLF = ["ip", "' - - ['", "{clf}", "' +0000] \"'", REQ, "'\" '", *_TAIL]
_UP = "upstream_addr"
LINES = {
    "nginx": _join(*_CLF),
    "apache": _join("ip", "' ident-x frank ['", "{clf}", "' +0000] \"'", REQ, "'\" '", *_TAIL),
    "traefik": _join(*_CLF, "' 12 \"router@docker\" \"http://'", _UP, "'\" '", _s("request_time_ms"), "'ms'"),
    "envoy": _join("'['", "{iso}", "'Z] \"'", REQ, "'\" '", _s("status_code"), "' - '", _s("request_length"), "' '",
                   _s("bytes_sent"), "' '", _s("request_time_ms"), "' '", _s("upstream_response_time_ms"), "'ms \"'",
                   "ip", "'\" \"'", AGENT, "'\" \"'", "request_id", "'\" \"'", "host", "'\" \"'", _UP, "'\"'"),
    "haproxy": _join("CASE WHEN status_code = 200 THEN 'Feb  3 11:22:33 web haproxy[14389]: ' ELSE '' END", "ip",
                     "':51000 ['", "{clf}", "'.123] http-in backend/srv 0/0/1/2/3 '", _s("status_code"), "' '",
                     _s("bytes_sent"), "' - - ---- 1/1/1/1/0 0/0 \"'", REQ, "'\"'"),
    "nginx-ingress": _join(*_CLF, "' '", _s("request_length"), "' 0.'", f"lpad({_s('request_time_ms')}, 4, '0')",
                           "' [backend] [] '", _UP, "',10.1.9.9:80 512,0 '",
                           f"{_s('upstream_response_time_ms')}", "'ms,- 200,502 '", "request_id"),
    "iis": _join("{iis}", "' 10.0.0.10 '", "method", "' '", "url", "' '",
                 "CASE WHEN status_code = 200 THEN concat('a=1&n=', " + _s("id") + ") ELSE '-' END",
                 "' 443 - '", "ip", "' '", f"replace({AGENT}, ' ', '+')", "' '",
                 "CASE WHEN referer = '' THEN '-' ELSE referer END", "' '", _s("status_code"), "' 0 0 36'"),
    "npm": _join("'['", "{clf}", "' +0000] - '", _s("status_code"), "' '", _s("status_code"), "' - '", "method",
                 "' https '", "host", "' \"'", "url", "'\" [Client '", "ip", "'] [Length '", _s("bytes_sent"),
                 "'] [Gzip -] [Sent-to '", _UP, "'] \"'", AGENT, "'\" \"'", "referer", "'\"'"),
    "safeline": ("CASE WHEN status_code = 200 THEN "
                 + _join("ip", "' - - ['", "{clf}", "' +0000] \"'", "host", "'\" \"'", REQ, "'\" '", *_TAIL, "' \"-\"'")
                 + " ELSE "
                 + _join("ip", "' | - | '", "{clf}", "' +0000 | \"'", "host", "'\" | \"'", REQ, "'\" | '",
                         _s("status_code"), "' | '", _s("bytes_sent"), "' | \"'", "referer", "'\" | \"'", AGENT, "'\"'")
                 + " END"),
    "caddy": _join("'{{\"level\":\"info\",\"ts\":'", _s("timestamp"), "CASE WHEN status_code = 200 THEN '.25' ELSE '' END",
                   "',\"request\":{{\"remote_ip\":\"'", "ip", "'\",\"proto\":\"HTTP/2.0\",\"method\":\"'", "method",
                   "'\",\"host\":\"'", "host", "'\",\"uri\":\"'", "url", "'\",\"headers\":{{\"user-agent\":[\"'", AGENT,
                   "'\"],\"Referer\":[\"'", "referer", "'\"]}}}},\"duration\":'", "CAST(CAST(request_time_ms AS DOUBLE) / 1000 AS STRING)",
                   "',\"size\":'", _s("bytes_sent"), "',\"status\":'", _s("status_code"), "',\"request_id\":\"'",
                   "request_id", "'\",\"upstream\":\"'", _UP, "'\",\"upstream_duration\":\"'",
                   _s("upstream_response_time_ms"), "'ms\"}}'"),
    "format": _join("ip", "' ['", "{clf}", "' +0000] \"'", REQ, "'\" '", _s("status_code"), "' '", _s("bytes_sent"),
                    "' '", _s("request_time_ms"), "' '", _s("request_length"), "' '", "request_id", "' ref=\"'",
                    "referer", "'\"'"),
    "regex": _join("'<<'", _s("timestamp"), "'000>> '", "ip", "' '", "method", "'|'", "url", "'|'", _s("status_code"),
                   "'|'", "referer", "'|'", _s("bytes_sent")),
}
# Every fiftieth line or so is a comment, blank or torn.
BROKEN = ("CASE id % 50 WHEN 7 THEN '#Fields: date time c-ip' WHEN 17 THEN '' "
          "WHEN 27 THEN concat('torn \"GET\" 200 ', CAST(id AS STRING)) ELSE {line} END")
GOOD = "id % 50 NOT IN (7, 17, 27)"

FORMATS = {n: ps.line_format(n) for n in ["nginx", "apache", "traefik", "envoy", "haproxy", "nginx-ingress", "iis",
                                          "npm", "safeline", "caddy"]}
FORMATS["format"] = ps.line_format(log_format='$remote_addr [$time_local] "$request" $status $body_bytes_sent '
                                              '$request_time $request_length $request_id ref="$http_referer"')
FORMATS["regex"] = ps.line_format(
    log_regex=r"<<(?P<time>\d+)>> (?P<remote_addr>\S+) (?P<request_method>[A-Z]+)\|(?P<uri>[^|]*)\|(?P<status>\d+)"
              r"\|(?P<http_referer>[^|]*)\|(?P<bytes_sent>\d+)")


def lines_sql(name: str, words: dict[str, str], source: str = "access_log") -> str:
    body = BROKEN.format(line=LINES[name].format(**words))
    return f"SELECT id, {body} AS line FROM {source}"


def lines_of(log, name):
    # Braces of JSON lines are doubled, since the text is formatted once more to name the frame.
    text = lines_sql(name, SPARK, "").replace("{", "{{").replace("}", "}}")
    # Lines come in many files; here they are dealt out over the tasks once they are made.
    return log.sparkSession.sql(text + "{log}", log=log).repartition("id")


def parsed(log, name, **options):
    return ps.parse_lines(lines_of(log, name), FORMATS[name], line="line", now=NOW, **options)


OUT = ["id", "timestamp", "ip", "method", "url", "status_code", "bytes_sent", "request_length", "request_time_ms",
       "upstream_response_time_ms", "upstream_addr", "host", "request_id", "referer", "browser", "os", "device",
       "domestic", "global", "pageview_flag"]
NO_AGENT = {"browser": "'未知浏览器'", "os": "'未知操作系统'", "device": "'其他设备'"}
PLAIN = {"request_length": "CAST(0 AS BIGINT)", "request_time_ms": "CAST(0 AS BIGINT)",
         "upstream_response_time_ms": "CAST(0 AS BIGINT)", "upstream_addr": "''", "host": "''", "request_id": "''",
         "domestic": "'待解析'", "global": "'待解析'"}


def _own(*names):
    return {n: n for n in names}


IIS_URL = "CASE WHEN status_code = 200 THEN concat(url, '?a=1&n=', CAST(id AS STRING)) ELSE url END"
# A query makes "/favicon.ico?.." and "/static/app.js?.." escape the patterns anchored at the end.
IIS_FLAG = ("CASE WHEN status_code = 200 AND NOT regexp_matches(ip, '^(10[.]|192[.]168[.])') "
            "AND NOT starts_with(url, '/api/') THEN 1 ELSE 0 END")
EXPECTED = {
    "nginx": {}, "apache": {},
    "traefik": _own("request_time_ms"),
    "envoy": {**_own("request_length", "upstream_response_time_ms", "upstream_addr", "host", "request_id"),
              "request_time_ms": "request_time_ms * 1000", "referer": "''"},
    "haproxy": {"referer": "''", **NO_AGENT},
    "nginx-ingress": {**_own("request_length", "upstream_response_time_ms", "request_id"),
                      "request_time_ms": "CAST(trunc(CAST(concat('0.', lpad(CAST(request_time_ms AS VARCHAR), 4, '0')) "
                                         "AS DOUBLE) * 1000) AS BIGINT)",
                      "upstream_addr": "concat(upstream_addr, ',10.1.9.9:80')"},
    "iis": {"bytes_sent": "CAST(0 AS BIGINT)", "url": IIS_URL, "pageview_flag": IIS_FLAG, "referer": "CASE WHEN referer = '' THEN '-' ELSE referer END"},
    "npm": _own("upstream_addr", "host"),
    "safeline": _own("host"),
    "caddy": {**_own("upstream_response_time_ms", "upstream_addr", "host", "request_id"),
              "request_time_ms": "CAST(trunc(CAST(CAST(CAST(request_time_ms AS DOUBLE) / 1000 AS VARCHAR) AS DOUBLE) "
                                 "* 1000) AS BIGINT)"},
    "format": {**_own("request_length", "request_id"), "request_time_ms": "request_time_ms * 1000", **NO_AGENT},
    "regex": NO_AGENT,
}
# The systems named in the agent text survive "+" for blanks only where the rule does not look for a blank.
IIS_SKIP = ["browser", "os", "device"]


def expected_sql(name: str) -> str:
    columns = {**PLAIN, **EXPECTED[name]}
    names = [c for c in OUT if not (name == "iis" and c in IIS_SKIP)]
    picks = ", ".join(f'{columns.get(c, chr(34) + c + chr(34))} AS "{c}"' for c in names)
    return f"SELECT {picks} FROM access_log WHERE {GOOD}"


def _format_query(name):
    def run(spark, sf):
        good = ps.good_rows(parsed(access_log(spark, sf), name), line="line")
        return good.drop(*IIS_SKIP) if name == "iis" else good
    return run


_OPS = {n: f"parse_{n}" for n in LINES} | {"nginx-ingress": "parse_ingress"}
for _name, _op in _OPS.items():
    REG.add(_op, _format_query(_name), over_log(expected_sql(_name)))


def q(name, build, body, *ctes):
    REG.add(name, lambda spark, sf: build(access_log(spark, sf)), over_log(body, *ctes))


# ---- refused lines ----------------------------------------------------------------------------------------------

_BAD = """SELECT id, CASE id % 10
 WHEN 1 THEN '' WHEN 2 THEN '#Software: x'
 WHEN 3 THEN concat(ip, ' i u [', {clf}, ' +0000] "GET" ', CAST(status_code AS STRING), ' 1 "-" "-"')
 WHEN 4 THEN concat(ip, ' i u [yesterday] "GET /x HTTP/1.1" 200 1 "-" "-"')
 WHEN 5 THEN concat(ip, ' i u [', {clf}, ' +0000] "" 200 1 "-" "-"')
 WHEN 6 THEN concat(ip, ' i u [', {clf}, ' +0000] "GET /x HTTP/1.1" 000 1 "-" "-"')
 WHEN 7 THEN concat(ip, ' i u [02/Jan/2023:10:00:00 +0800] "GET /x HTTP/1.1" 200 1 "-" "-"')
 WHEN 8 THEN concat(', ', ip, ' i u [', {clf}, ' +0000] "GET /x HTTP/1.1" 200 1 "-" "-"')
 ELSE concat(ip, ' i u [', {clf}, ' +0000] "GET ', url, '%zz HTTP/1.1" 200 - "-" "-"') END AS line FROM """


def _bad(log):
    lines = log.sparkSession.sql(_BAD.format(**SPARK).replace("FROM ", "FROM {log}"), log=log)
    return ps.bad_rows(ps.parse_lines(lines, FORMATS["apache"], line="line", now=NOW, retention_days=30), line="line")


q("bad_rows", _bad,
  """SELECT id, line, CASE id % 10 WHEN 1 THEN 'format' WHEN 2 THEN 'format' WHEN 3 THEN 'request' WHEN 4 THEN 'time'
  WHEN 5 THEN 'missing field' WHEN 6 THEN 'status' WHEN 7 THEN 'expired' WHEN 8 THEN 'format' END AS parse_error
  FROM lines WHERE id % 10 BETWEEN 1 AND 8""", f"lines AS ({_BAD.format(**DUCK)} access_log)")


def _retention(log):
    lines = lines_of(log, "nginx")
    made = ps.parse_lines(lines, FORMATS["nginx"], line="line", now=NOW, retention_days=10)
    return ps.good_rows(made, line="line").select("id", "timestamp")


q("retention_filter", _retention,
  f"SELECT id, timestamp FROM access_log WHERE {GOOD} AND timestamp >= {NOW_TS - 10 * 86400}")

# ---- field rules ------------------------------------------------------------------------------------------------
# Samples cycle over the rows; each sample names its own result, so the check does not repeat the rule.


def _case(values):
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE id % {len(values)} {arms} END"


def samples(name, pairs, column, kind=""):
    """``pairs`` of (input SQL, expected SQL) over the log's rows; ``column`` maps the input column to a result."""
    given, want = _case([p[0] for p in pairs]), _case([p[1] for p in pairs])
    want = f"CAST({want} AS {kind})" if kind else want
    q(name, lambda log: log.sparkSession.sql(f"SELECT id, {given} AS raw FROM {{log}}", log=log)
      .select("id", "raw", column(F.col("raw")).alias("value")),
      f"SELECT id, {given} AS raw, {want} AS value FROM access_log")


_ID = "CAST(id AS STRING)"
samples("parse_int_fields", [
    ("'512'", "512"), (_ID, "id"), ("'-'", "0"), ("''", "0"), ("'  64 '", "64"), ("'-5'", "0"), ("'12x'", "0"),
    ("'99999999999999999999'", "0"), ("'1.5'", "0"), ("'+7'", "7")], text.parse_int, "BIGINT")
samples("optional_field", [
    ("'-'", "''"), ("''", "''"), ("' - '", "''"), (f"concat(' req-', {_ID}, ' ')", f"concat('req-', {_ID})"),
    ("'--'", "'--'")], text.optional_field)
samples("parse_duration", [
    ("'0.245'", "245"), ("'0.1, 0.3'", "300"), ("'1m2s'", "62000"), ("'-'", "0"), ("'5x'", "0"), ("'1h2m3.5s'", "3723500"),
    ("'12ms'", "12"), ("'1500us'", "1"), ("'1500µs'", "1"), ("'2000000000'", "2000"), (_ID, "id * 1000"),
    (f"concat({_ID}, 'ms')", "id"), ("'-, -'", "0"), ("'0.2, -'", "200"), ("''", "0"), ("'-3'", "0"),
    ("'3MS, 1s'", "1000"), ("' 0.5 '", "500"), ("'1e2'", "100000"), ("'7 s'", "0")], times.parse_duration, "BIGINT")
samples("parse_duration_ms", [
    ("'245.9'", "245"), (_ID, "id"), ("'-1'", "0"), ("'2s'", "2000"), ("'10, 30'", "30")],
        lambda c: times.parse_duration(c, True), "BIGINT")
_TS = "CAST(timestamp AS STRING)"


def _parse_time(log):
    given = _TIME_GIVEN.format(**SPARK)
    rows = log.sparkSession.sql(f"SELECT id, {given} AS raw FROM {{log}}", log=log)
    return rows.select("id", "raw", times.parse_time("raw").alias("value"))


_TIME_GIVEN = ("CASE id % 9 WHEN 0 THEN concat({clf}, ' +0000') WHEN 1 THEN concat({clf}, ' +0800') "
               f"WHEN 2 THEN {_TS} WHEN 3 THEN concat({_TS}, '.789') WHEN 4 THEN concat({_TS}, '123') "
               "WHEN 5 THEN concat({iso}, 'Z') WHEN 6 THEN concat({iso}, '.123456-05:30') WHEN 7 THEN {iis} "
               "ELSE 'noon' END")
q("parse_time", _parse_time,
  f"""SELECT id, {_TIME_GIVEN.format(**DUCK)} AS raw, CASE id % 9 WHEN 0 THEN timestamp
  WHEN 1 THEN timestamp - 28800 WHEN 2 THEN timestamp WHEN 3 THEN timestamp WHEN 4 THEN timestamp
  WHEN 5 THEN timestamp WHEN 6 THEN timestamp + 19800 END AS value FROM access_log""")
samples("decode_url", [
    ("concat('/a%20b/', CAST(id AS STRING))", f"concat('/a b/', {_ID})"), ("'/x+y'", "'/x y'"), ("'/100%'", "'/100%'"),
    ("'/a%zz+b'", "'/a%zz+b'"), ("'/%e4%bd%a0'", "'/你'"), ("url", "url"), ("'/%2B'", "'/+'")], text.decode_url)
samples("normalize_ip", [
    ("ip", "ip"), ("concat(ip, ', 10.0.0.1')", "ip"), ("'[2001:db8::5]:443'", "'2001:db8::5'"),
    ("'198.51.100.7:8080'", "'198.51.100.7'"), ("' 198.51.100.8 '", "'198.51.100.8'"), ("'fe80::1'", "'fe80::1'"),
    ("', 10.0.0.1'", "''"), ("'unix:'", "'unix:'"), ("''", "''"), ("'[broken'", "'[broken'")], net.normalize_ip)
samples("is_private_ip", [
    ("concat('10.1.2.', CAST(id % 250 AS STRING))", "true"), ("'172.16.0.1'", "true"), ("'172.31.255.255'", "true"),
    ("'172.32.0.1'", "false"), ("'192.168.3.4'", "true"), ("'127.0.0.1'", "true"), ("'169.254.1.1'", "true"),
    ("'8.8.8.8'", "false"), ("'::1'", "true"), ("'fe80::1'", "true"), ("'fd12:3456::1'", "true"), ("'2001:db8::1'", "false"),
    ("'::ffff:10.0.0.1'", "true"), ("'ff02::1'", "true"), ("'10.0.0.256'", "false"), ("'host'", "false"),
    ("'224.0.0.9'", "true"), ("'10.00.0.1'", "false"), ("'fc00::1::2'", "false"), ("''", "false")], net.is_private_ip)
samples("ip_key", [
    ("concat('10.1.2.', CAST(id % 250 AS STRING))",
     "concat('00000000000000000000ffff0a0102', lpad(lower(to_hex(id % 250)), 2, '0'))"),
    ("'2001:db8::1'", "'20010db8000000000000000000000001'"), ("'::'", "'00000000000000000000000000000000'"),
    ("'1:2:3:4:5:6:7::'", "'00010002000300040005000600070000'"), ("'::ffff:1.2.3.4'", "'00000000000000000000ffff01020304'"),
    ("'1:2:3:4:5:6:7::8'", "NULL"), ("':::'", "NULL"), ("'g::1'", "NULL"), ("'1.2.3'", "NULL"), ("'ABCD::'",
     "'abcd0000000000000000000000000000'")], net.ip_key)
samples("classify_ua", [
    (f"concat('Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.', {_ID}, ' Safari/537.36')",
     "'Chrome|Windows|桌面设备'"),
    ("'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0'",
     "'Edge|Windows|桌面设备'"),
    ("'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15'",
     "'Safari|macOS|桌面设备'"),
    ("'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'", "'Firefox|Linux|桌面设备'"),
    ("'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) CriOS/120.0 Mobile/15E148 Safari/604.1'",
     "'Chrome|iOS|手机'"),
    ("'Mozilla/5.0 (iPad; CPU OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1'",
     "'Safari|iOS|平板'"),
    ("'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36'",
     "'Chrome|Android|手机'"),
    ("'Mozilla/5.0 (Linux; Android 13; SM-T870) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0.0.0 Safari/537.36'",
     "'Samsung Browser|Android|平板'"),
    ("'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'", "'蜘蛛|蜘蛛|蜘蛛'"),
    ("'Mozilla/5.0 (compatible; Baiduspider/2.0; +http://www.baidu.com/search/spider.html)'", "'蜘蛛|蜘蛛|蜘蛛'"),
    ("'curl/8.0.1'", "'curl|未知操作系统|其他设备'"), ("'-'", "'未知浏览器|未知操作系统|其他设备'"),
    ("'Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko'", "'Internet Explorer|Windows|桌面设备'"),
    ("'Opera/9.80 (J2ME/MIDP; Opera Mini/9.80; U; en) Presto/2.5.25 Version/10.54'", "'Opera Mini|未知操作系统|其他设备'"),
    ("'Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36 OPR/105.0.0.0'",
     "'Opera|ChromeOS|桌面设备'"),
    ("'Mozilla/5.0 (Windows Phone 10.0; Android 6.0.1) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/52.0 Mobile Safari/537.36 Edge/15.14'",
     "'Edge|Windows Phone|手机'")],
    lambda c: F.concat_ws("|", agents.classify_ua(c)["browser"], agents.classify_ua(c)["os"],
                          agents.classify_ua(c)["device"]))
_LONG = "repeat('x', 1999)"
samples("sanitize", [
    ("concat('/a', chr(0), 'b')", "'/ab'"), ("url", "url"), (f"concat({_LONG}, 'é')", _LONG),
    (f"concat({_LONG}, 'yz')", f"concat({_LONG}, 'y')"), ("repeat('你', 700)", "repeat('你', 666)"), ("''", "''")],
        lambda c: text.cut_bytes(text.clean_utf8(c), 2000))

q("split_request_line", lambda log: log.select("id", F.concat("method", F.lit("  "), "url", F.lit(" HTTP/1.1"))
                                              .alias("raw")).select(
    "id", F.try_element_at(text.request_parts("raw"), F.lit(1)).alias("method"),
    F.try_element_at(text.request_parts("raw"), F.lit(2)).alias("url")),
  "SELECT id, method, url FROM access_log")
q("append_query", lambda log: log.sparkSession.sql(
    "SELECT id, CASE id % 4 WHEN 0 THEN url ELSE concat(url, '?q') END AS u, CASE id % 3 WHEN 0 THEN '-' WHEN 1 THEN "
    "concat('?n=', CAST(id AS STRING)) ELSE concat('n=', CAST(id AS STRING)) END AS qs FROM {log}", log=log)
  .select("id", text.append_query("u", "qs").alias("url")),
  """SELECT id, CASE WHEN id % 4 <> 0 THEN concat(url, '?q') WHEN id % 3 = 0 THEN url
  ELSE concat(url, '?n=', CAST(id AS VARCHAR)) END AS url FROM access_log""")


def _field_alias(log):
    """Two groups for one field: the first alias of the pattern wins, even where it is empty."""
    made = ps.line_format(log_regex=r"(?P<uri>\S*);(?P<url>\S*);(?P<client_ip>\S+);(?P<time>\d+);(?P<status>\d+);"
                                    r"(?P<server_name>\S*);(?P<http_host>\S*);(?P<method>\S+)")
    lines = log.select("id", F.concat_ws(";", F.lit("/from-uri"), "url", "ip", F.col("timestamp").cast("string"),
                                         F.col("status_code").cast("string"), "host", F.lit("-"), "method").alias("line"))
    out = ps.parse_lines(lines, made, line="line", now=NOW)
    return ps.good_rows(out, line="line").select("id", "ip", "url", "host")


q("field_alias", _field_alias, "SELECT id, ip, url, '' AS host FROM access_log")


def _flags(log):
    rules = pageview.PageviewRules(exclude_ips=["203.0.113.9", "2001:0db8:0::1"])
    open_rules = pageview.PageviewRules(status_include=[200, 301], exclude_ips=[])
    return log.select("id", pageview.pageview_flag("status_code", "url", "ip").alias("default_flag"),
                      pageview.pageview_flag("status_code", "url", "ip", rules).alias("ip_flag"),
                      pageview.pageview_flag("status_code", "url", "ip", open_rules).alias("open_flag"))


q("pageview_flag", _flags,
  """SELECT id, pageview_flag AS default_flag, CASE WHEN ip IN ('203.0.113.9', '2001:db8::1') THEN 0 ELSE
  pageview_flag END AS ip_flag, CASE WHEN status_code IN (200, 301) AND NOT regexp_matches(url,
  '(favicon.ico$|[.]js$|^/api/)') THEN 1 ELSE 0 END AS open_flag FROM access_log""")

# ---- push batches -----------------------------------------------------------------------------------------------


def _batches(log):
    """A hundred neighbouring lines per batch; every line of a third of the rows is sent twice."""
    lines = lines_of(log, "nginx")
    twice = lines.withColumn("n", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2)))
                                            .otherwise(F.array(F.lit(1)))))
    return twice.groupBy(F.expr("id div 100").alias("batch")).agg(F.collect_list("line").alias("lines")).select(
        F.lit("a1b2").alias("website_id"), F.lit("push").alias("source_id"), "lines")


q("ingest_lines", lambda log: ps.good_rows(
    ps.ingest_lines(_batches(log), {"": FORMATS["nginx"]}, now=NOW), line="line")
  .select("website_id", "timestamp", "ip", "method", "url", "status_code", "bytes_sent", "referer", "browser", "device"),
  f"""SELECT DISTINCT 'a1b2' AS website_id, timestamp, ip, method, url, status_code, bytes_sent, referer, browser, device
  FROM access_log WHERE {GOOD}""")


def _dup(log):
    lines = lines_of(log, "nginx").select(F.lit("a1b2").alias("website_id"),
                                          F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source_id"), "line")
    return ps.dedup_lines(lines.unionByName(lines))


q("dedup_lines", _dup,
  f"""SELECT DISTINCT 'a1b2' AS website_id, concat('s', CAST(id % 2 AS VARCHAR)) AS source_id, line FROM
  ({lines_sql("nginx", DUCK)})""")
