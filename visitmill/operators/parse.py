"""Raw lines to access-log records.

Steps that no filter repeats decide about a line (its groups, then time, address and status); the other columns follow as a plain
projection, so refused lines never reach them and columns that nobody reads are not computed. All groups of a format are taken out with a single regular-expression pass: the line is rewritten to its groups,
separated by a control character, and split. Lines that hold that character themselves take the slower
group-by-group way.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.functions.agents import classify_ua
from visitmill.functions.net import normalize_ip
from visitmill.functions.pageview import PageviewRules, pageview_flag
from visitmill.functions.text import (append_query, decode_url, optional_field, parse_int, request_parts,
                                      sanitize_columns)
from visitmill.functions.times import (HAPROXY_LAYOUT, IIS_LAYOUT, epoch_number, parse_duration, parse_time,
                                       pattern_of)
from visitmill.operators.agents import AgentTable
from visitmill.plans.clock import epoch, wall_clock
from visitmill.schema import ACCESS_LOG, DEDUP_MINUTES, PENDING, UNKNOWN

# The line patterns of the built-in formats.
PATTERNS = {
    "nginx": r'^(?P<ip>\S+) - (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<method>\S+) (?P<url>[^"]+) HTTP/\d\.\d" (?P<status>\d+) (?P<bytes>\d+) "(?P<referer>[^"]*)" "(?P<ua>[^"]*)"',
    "apache": r'^(?P<ip>\S+) (?P<ident>\S+) (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d{3}) (?P<bytes>\d+|-) "(?P<referer>[^"]*)" "(?P<ua>[^"]*)"',
    "traefik": r'^(?P<ip>\S+) (?P<ident>\S+) (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d{3}) (?P<bytes>\d+|-) "(?P<referer>[^"]*)" "(?P<ua>[^"]*)" (?P<req_count>\d+) "(?P<router>[^"]*)" "(?P<server_url>[^"]*)" (?P<duration_ms>[0-9.]+)ms',
    "envoy": r'^\[(?P<time>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d{3}) (?P<response_flags>\S+) (?P<bytes_received>\d+) (?P<bytes>\d+) (?P<duration>\d+) (?P<upstream_time>\S+) "(?P<ip>[^"]*)" "(?P<ua>[^"]*)" "(?P<request_id>[^"]*)" "(?P<authority>[^"]*)" "(?P<upstream_host>[^"]*)"',
    "haproxy": r'^(?:\w{3}\s+\d+\s+\d+:\d+:\d+\s+\S+\s+\S+\[\d+\]:\s+)?(?P<ip>\S+):\d+\s+\[(?P<time>[^\]]+)\]\s+\S+\s+\S+\s+-?\d+/-?\d+/-?\d+/-?\d+/-?\d+\s+(?P<status>\d{3})\s+(?P<bytes>\d+|-)\s+\S+\s+\S+\s+\S+\s+-?\d+/-?\d+/-?\d+/-?\d+/-?\d+\s+-?\d+/-?\d+(?:\s+(?:\{[^\}]*\}|-)){0,2}\s+\"(?P<request>[^\"]*)\"',
    "nginx-ingress": r'^(?P<ip>\S+) - (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d{3}) (?P<bytes>\d+|-) "(?P<referer>[^"]*)" "(?P<ua>[^"]*)" (?P<request_length>\d+) (?P<request_time>[0-9.]+) \[(?P<proxy_upstream_name>[^\]]*)\] \[(?P<proxy_alternative_upstream_name>[^\]]*)\] (?P<upstream_addr>[^ ]+(?:,\s*[^ ]+)*) (?P<upstream_response_length>[^ ]+(?:,\s*[^ ]+)*) (?P<upstream_response_time>[^ ]+(?:,\s*[^ ]+)*) (?P<upstream_status>[^ ]+(?:,\s*[^ ]+)*) (?P<req_id>\S+)',
    "iis": r'^(?P<time>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(?P<method>\S+)\s+(?P<url>\S+)\s+(?P<query>\S+)\s+\S+\s+\S+\s+(?P<ip>\S+)\s+(?P<ua>\S+)\s+(?P<referer>\S+)\s+(?P<status>\d{3})(?:\s+\S+){3}\s*$',
    "npm": r'^\[(?P<time>[^\]]+)\] - (?P<status>\d+) (?P<upstream_status>\d+) - (?P<method>\S+) (?P<scheme>\S+) (?P<host>\S+) "(?P<path>[^"]+)" \[Client (?P<ip>[^\]]+)\] \[Length (?P<bytes>\d+)\] \[Gzip (?P<gzip>[^\]]+)\] \[Sent-to (?P<upstream>[^\]]+)\] "(?P<ua>[^"]+)" "(?P<referer>[^"]*)"',
    "safeline": r'^(?P<ip>\S+)\s*(?:\|\s*|-\s+)(?P<user>\S+)\s*(?:\|\s*|\[\s*)(?P<time>[^\]|]+?)(?:\]\s+|\s*\|\s*)"(?P<host>[^"]*)"\s*(?:\|\s*|\s+)"(?P<request>[^"]*)"\s*(?:\|\s*|\s+)(?P<status>\d{3})\s*(?:\|\s*|\s+)(?P<bytes>\d+|-)\s*(?:\|\s*|\s+)"(?P<referer>[^"]*)"\s*(?:\|\s*|\s+)"(?P<ua>[^"]*)"(?:\s*(?:\|\s*|\s+)"(?P<http_x_forwarded_for>[^"]*)")?$',
}

# Other names of the built-in formats.
FORMAT_NAMES = {
    "": "nginx", "tengine": "nginx", "httpd": "apache", "apache-httpd": "apache",
    "traefik-ingress": "traefik", "ingress-nginx": "nginx-ingress", "haproxy-ingress": "haproxy",
    "iis-w3c": "iis", "w3c-iis": "iis", "nginx-proxy-manager": "npm",
    "safeline-waf": "safeline", "raywaf": "safeline", "ray-waf": "safeline", "leichi": "safeline",
    "leichi-waf": "safeline",
}

# Group names that stand for a field, in order of preference.
ALIASES = {
    "ip": ["ip", "remote_addr", "client_ip", "http_x_forwarded_for"],
    "time": ["time", "time_local", "time_iso8601"],
    "method": ["method", "request_method"],
    "url": ["url", "request_uri", "uri", "path"],
    "query": ["query", "args", "query_string", "cs_uri_query"],
    "status": ["status"],
    "bytes": ["bytes", "body_bytes_sent", "bytes_sent"],
    "referer": ["referer", "http_referer"],
    "ua": ["ua", "user_agent", "http_user_agent"],
    "request": ["request", "request_line"],
    "request_length": ["request_length", "bytes_received"],
    "time_in_ms": ["request_time_ms", "request_time_msec", "duration_ms"],
    "time_in_s": ["request_time", "duration"],
    "upstream_time": ["upstream_response_time", "upstream_time"],
    "upstream_addr": ["upstream_addr", "upstream", "upstream_host"],
    "host": ["host", "http_host", "server_name", "authority"],
    "request_id": ["request_id", "req_id", "x_request_id"],
}

# Variables of a line format -> (group name, token kind).
VARIABLES = {
    "remote_addr": ("ip", "required"), "http_x_forwarded_for": ("http_x_forwarded_for", "list"),
    "remote_user": ("user", "optional"), "time_local": ("time", "bracket"), "time_iso8601": ("time", "required"),
    "request": ("request", "required"), "request_method": ("method", "required"),
    "request_uri": ("url", "required"), "uri": ("url", "required"), "args": ("args", "optional"),
    "query_string": ("query_string", "optional"), "status": ("status", "status"),
    "body_bytes_sent": ("bytes", "digits"), "bytes_sent": ("bytes", "digits"),
    "http_referer": ("referer", "optional"), "http_user_agent": ("ua", "optional"),
    "host": ("host", "required"), "http_host": ("host", "required"), "server_name": ("server_name", "required"),
    "scheme": ("scheme", "required"), "request_length": ("request_length", "digits"),
    "remote_port": ("remote_port", "digits"), "connection": ("connection", "digits"),
    "request_time": ("request_time", "number"), "request_time_msec": ("request_time_msec", "number"),
    "upstream_addr": ("upstream_addr", "list"), "upstream_status": ("upstream_status", "list"),
    "upstream_response_time": ("upstream_response_time", "list"),
    "upstream_connect_time": ("upstream_connect_time", "list"),
    "upstream_header_time": ("upstream_header_time", "list"), "request_id": ("request_id", "required"),
}

# Token kind -> pattern outside and inside quotes.
TOKENS = {
    "required": (r"\S+", r'[^"]+'), "optional": (r"\S*", r'[^"]*'),
    "list": (r"[^,\s]+(?:,\s*[^,\s]+)*",) * 2, "bracket": (r"[^]]+",) * 2, "status": (r"\d{3}",) * 2,
    "digits": (r"\d+",) * 2, "number": (r"\d+(?:\.\d+)?",) * 2,
}

_MARK = "\x01"
_RAW = ["ip", "time", "method", "url", "query", "status", "bytes", "referer", "ua", "request", "request_length",
        "time_in_ms", "time_in_s", "upstream_time", "upstream_addr", "host", "request_id"]
#: Fields that do not decide whether a line is good.
_LATER = ["bytes", "request_length", "time_in_ms", "time_in_s", "upstream_time", "upstream_addr", "host", "request_id", "referer", "ua"]


@dataclasses.dataclass(frozen=True)
class LineFormat:
    """How lines are read: a pattern with named groups, or JSON lines."""

    pattern: str = ""
    layout: str = ""
    json: bool = False

    @property
    def groups(self) -> dict[str, int]:
        return dict(re.compile(self.pattern).groupindex)

    @property
    def java_pattern(self) -> str:
        return re.sub(r"\(\?P<\w+>", "(", self.pattern)

    def group_of(self, field: str) -> int | None:
        """Group of the first alias that the pattern has, even if that group is empty on a line."""
        groups = self.groups
        return next((groups[a] for a in ALIASES[field] if a in groups), None)


def pattern_from_format(text: str) -> str:
    """``$var`` line format to an anchored pattern; a variable is captured once, unknown ones match a token."""
    pieces = re.split(r"\$(\w+)", text)
    if len(pieces) == 1:
        raise ValueError("the line format holds no variable")
    out, used = re.escape(pieces[0]), set()
    for i in range(1, len(pieces), 2):
        quoted = pieces[i - 1].rstrip(" \t\r\n").endswith('"') and pieces[i + 1].lstrip(" \t\r\n").startswith('"')
        group, kind = VARIABLES.get(pieces[i], ("", "optional"))
        token = TOKENS[kind][quoted]
        if group and group not in used:
            used.add(group)
            token = f"(?P<{group}>{token})"
        out += token + re.escape(pieces[i + 1])
    return f"^{out}$"


def line_format(log_type: str = "", log_format: str = "", log_regex: str = "", layout: str = "") -> LineFormat:
    """A user pattern wins over a ``$var`` format, which wins over a built-in type."""
    kind = log_type.strip().lower()
    kind = FORMAT_NAMES.get(kind, kind)
    if log_regex.strip():
        pattern = log_regex.strip()
        pattern = ("" if pattern.startswith("^") else "^") + pattern + ("" if pattern.endswith("$") else "$")
    elif log_format.strip():
        pattern = pattern_from_format(log_format)
    elif kind == "caddy":
        return LineFormat(layout=layout, json=True)
    elif kind in PATTERNS:
        pattern = PATTERNS[kind]
        layout = layout.strip() or {"haproxy": HAPROXY_LAYOUT, "iis": IIS_LAYOUT}.get(kind, "")
    else:
        raise ValueError(f"unknown log type: {log_type}")
    made = LineFormat(pattern, layout)
    if layout:
        pattern_of(layout)
    for need in (["ip"], ["time"], ["status"], ["url", "request"]):
        if all(made.group_of(field) is None for field in need):
            raise ValueError(f"the pattern needs a group for {' or '.join(need)}")
    return made


def _groups(made: LineFormat, line: Column, fields: list[str]) -> tuple[Column, Column, dict[str, int]]:
    """``_fast``, the array of the groups in use (NULL when the line does not match) made of it, and field -> array position."""
    numbers = {f: made.group_of(f) for f in fields}
    wanted = sorted({n for n in numbers.values() if n is not None})
    java = made.java_pattern
    # A user pattern may end in "$" already; the tail then matches nothing.
    fast = F.split(F.regexp_replace(line, java + r"[\s\S]*", _MARK.join(f"${n}" for n in wanted)), _MARK, -1)
    slow = F.when(line.rlike(java), F.array(*[F.regexp_extract(line, java, n) for n in wanted]))
    chosen = F.when(line.contains(_MARK), slow).when(F.size("_fast") == len(wanted), F.col("_fast"))
    return fast, chosen, {f: wanted.index(n) for f, n in numbers.items() if n is not None}


def apart(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later steps and filters read but never repeat: they leave through a one-element array.

    The optimiser moves filters below projections and writes the projected expressions into them. Nothing moves below this step, so it
    is for what every reader needs; columns that only some need belong after it, where they are dropped if nobody asks.
    """
    # First a projection, where common parts are computed once; the array then only holds its columns.
    kept, ready = rows.columns, rows.withColumns({f"{n}0": c for n, c in columns.items()})
    return ready.select(*kept, F.inline(F.array(F.struct(*[F.col(f"{n}0").alias(n) for n in columns]))))


def raw_fields(lines: DataFrame, made: LineFormat, line: str = "value", wanted: list[str] | None = None) -> DataFrame:
    """Adds ``_matched`` and one text column per field (``r_ip`` ...), blank where the format has none. With ``wanted``, patterns
    fill only the fields it names and those that tell whether a line matches."""
    if made.json:
        return _json_fields(lines, line)
    # A line that does not match stays in one piece, so two groups are the fewest that tell it from one that does.
    fast, groups, at = _groups(made, F.col(line), _RAW if wanted is None else ["ip", "time", *wanted])
    split = apart(lines.withColumn("_fast", fast), _g=groups).drop("_fast")
    fields = [F.coalesce(F.col("_g")[at[f]], F.lit("")) if f in at else F.lit("") for f in _RAW]
    return split.select(*lines.columns, F.col("_g").isNotNull().alias("_matched"),
                        *[c.alias(f"r_{f}") for f, c in zip(_RAW, fields)])


def _json_fields(lines: DataFrame, line: str) -> DataFrame:
    parsed = apart(lines, _v=F.try_parse_json(line))
    v = F.col("_v")

    def text(*paths: str) -> Column:
        found = [F.when(F.try_variant_get(v, p, "string") != "", F.try_variant_get(v, p, "string")) for p in paths]
        return F.coalesce(*found, F.lit(""))

    def header(name: str) -> Column:
        entries = F.map_entries(F.try_variant_get(v, "$.request.headers", "map<string,variant>"))
        value = F.filter(entries, lambda e: F.lower(e["key"]) == name.lower())[0]["value"]
        first = F.try_variant_get(value, "$[0]", "string")
        return F.coalesce(first, F.try_variant_get(value, "$", "string"), F.lit(""))

    def number(path: str) -> Column:
        return F.try_variant_get(v, path, "double").try_cast("long").cast("string")

    def time(path: str) -> Column:
        """JSON integers are whole seconds as they stand; text and fractions follow the usual rules."""
        value = F.try_variant_get(v, path, "variant")
        whole = F.schema_of_variant(value) == "BIGINT"
        # Marked, so that an integer above 1e12 is not taken for milliseconds.
        return F.when(whole, F.concat(F.lit("="), F.try_variant_get(v, path, "string"))).otherwise(
            F.try_variant_get(v, path, "string"))

    fields = {
        "ip": text("$.request.remote_ip", "$.request.client_ip", "$.remote_ip"),
        "time": F.coalesce(time("$.ts"), time("$.time"), time("$.timestamp"), F.lit("")),
        "method": text("$.request.method"), "url": text("$.request.uri"), "query": F.lit(""),
        "status": F.coalesce(number("$.status"), F.lit("")), "bytes": F.coalesce(number("$.size"), F.lit("")),
        "referer": header("Referer"), "ua": header("User-Agent"), "request": F.lit(""),
        "request_length": F.coalesce(number("$.request_length"), F.lit("")),
        "time_in_ms": text("$.duration_ms"), "time_in_s": text("$.duration", "$.duration_ns"),
        "upstream_time": text("$.upstream_duration"), "upstream_addr": text("$.upstream"),
        "host": text("$.request.host"), "request_id": text("$.request_id"),
    }
    return parsed.select(*lines.columns, v.isNotNull().alias("_matched"),
                         *[fields[f].alias(f"r_{f}") for f in _RAW])


def _request(raw: DataFrame) -> DataFrame:
    """Method and url: from their own groups, else from the request line."""
    needed = (F.col("r_method") == "") | (F.col("r_url") == "")
    split = raw.withColumn("_w", F.when(needed & (F.col("r_request") != ""), request_parts("r_request")))
    words = F.col("_w")
    short = words.isNotNull() & (F.size(words) < 2)
    method = F.when(F.col("r_method") != "", F.col("r_method")).otherwise(
        F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))
    url = F.when(F.col("r_url") != "", F.col("r_url")).otherwise(
        F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))
    return split.select(*raw.columns, short.alias("_short"), method.alias("_method"),
                        append_query(url, "r_query").alias("_url"))


def parse_lines(lines: DataFrame, made: LineFormat, *, line: str = "value", now: dt.datetime | None = None,
                retention_days: int | None = None, rules: PageviewRules | None = None,
                native_units: bool = False, agents: AgentTable | None = None) -> DataFrame:
    """Records with a ``parse_error`` column: NULL for good rows, else why the line is refused.

    ``retention_days`` refuses rows older than that; without it rows of any age are good, so that old logs can be read in.
    Columns of ``lines`` such as ``website_id`` or ``id`` are carried along. ``native_units`` reads a ``duration``
    group without unit as milliseconds, which is what Envoy writes; by default it counts as seconds. With ``agents`` the labels of
    user agents come from that table, which ``agents_of`` feeds; else the rules run on every line.
    """
    keep = [c for c in lines.columns if c != line]
    fields = _request(raw_fields(lines, made, line))
    time = F.col("r_time")
    if made.json:
        whole = F.substring(time, 2, 30).try_cast("long")
        ts = F.when(time.startswith("="), whole).otherwise(F.coalesce(
            parse_time(time, made.layout), epoch_number(time.try_cast("double"))))
    else:
        ts = parse_time(time, made.layout)
    in_ms = made.json or made.group_of("time_in_ms") is not None
    duration = F.when(F.col("r_time_in_ms") != "", parse_duration("r_time_in_ms", True)).otherwise(
        parse_duration("r_time_in_s", native_units)) if in_ms else parse_duration("r_time_in_s", native_units)
    missing = (F.col("r_ip") == "") | (F.col("r_time") == "") | (F.col("r_status") == "") | (F.col("_url") == "")
    # Two steps are not repeated: the groups of a line (above), and what decides whether it is refused. The rest is plain projection,
    # which refused lines and unread columns never reach.
    later = [f"r_{f}" for f in _LATER]
    decided = apart(
        fields.withColumn("_missing", missing), _ts=ts, _ip=normalize_ip("r_ip"), _status=F.col("r_status").try_cast("int"),
        _verb=F.col("_method"), _path=F.col("_url"), _torn=F.col("_short")).select(
        *keep, line, *later, "_matched", "_missing", "_ts", "_ip", "_status", F.col("_verb").alias("_method"), F.col("_path").alias("_url"),
        F.col("_torn").alias("_short"))
    reason = (F.when(~F.col("_matched"), "format").when(F.col("_short"), "request").when(F.col("_missing"), "missing field")
              .when(F.col("_ts").isNull(), "time").when(F.col("_status").isNull(), "status")
              .when((F.col("_ip") == "") | (F.col("_method") == ""), "missing field")
              .when(F.col("_status") <= 0, "status"))
    if retention_days is not None:
        cutoff = epoch(now or wall_clock()) - retention_days * 86400
        reason = reason.when(F.col("_ts") < cutoff, "expired")
    carried = [c for c in keep if c not in ("domestic", "global")]
    agent = _agent_text()
    rows = decided.withColumn("url", decode_url("_url"))
    rows = agents.label(rows, agent, line) if agents else rows.withColumn("_agent", classify_ua(agent))
    return rows.select(
        *carried, line, F.col("_ts").alias("timestamp"), F.col("_ip").alias("ip"), F.col("_method").alias("method"), "url",
        F.col("_status").alias("status_code"), parse_int("r_bytes").alias("bytes_sent"),
        parse_int("r_request_length").alias("request_length"), duration.alias("request_time_ms"),
        parse_duration("r_upstream_time").alias("upstream_response_time_ms"),
        optional_field("r_upstream_addr").alias("upstream_addr"), optional_field("r_host").alias("host"),
        optional_field("r_request_id").alias("request_id"), decode_url("r_referer").alias("referer"),
        F.col("_agent.browser").alias("browser"), F.col("_agent.os").alias("os"), F.col("_agent.device").alias("device"),
        *pending_location("_ip"), pageview_flag("_status", "url", "_ip", rules).alias("pageview_flag"),
        reason.alias("parse_error"))


def _agent_text() -> Column:
    return F.when(F.col("r_ua") == "", "-").otherwise(F.col("r_ua"))


def agents_of(lines: DataFrame, made: LineFormat, line: str = "value") -> DataFrame:
    """(agent) of all lines that match, for ``AgentTable.learn``; nothing else of a line is parsed for it."""
    return raw_fields(lines, made, line, ["ua"]).filter("_matched").select(_agent_text().alias("agent"))


def good_rows(parsed: DataFrame, line: str = "value", limits: dict[str, int] | None = None) -> DataFrame:
    """Records fit for storage: errors dropped, text cleaned and, with ``limits``, cut to so many bytes.

    Rows without an id get one from their own content, so it stays the same when a task is run again.
    """
    good = parsed.filter(F.col("parse_error").isNull())
    if "id" not in good.columns:
        origin = [c for c in ("website_id", "source_id", "path") if c in good.columns]
        good = good.withColumn("id", F.xxhash64(*origin, line))
    good = good.withColumns(sanitize_columns(good.columns, limits))
    names = [f.name for f in ACCESS_LOG.fields if f.name in good.columns]
    return good.select(*names)


def bad_rows(parsed: DataFrame, line: str = "value") -> DataFrame:
    keep = [c for c in ("website_id", "source_id", "path", "id") if c in parsed.columns]
    return parsed.filter(F.col("parse_error").isNotNull()).select(*keep, F.col(line), "parse_error")


def pending_location(ip: str) -> list[Column]:
    """New rows wait for their location; rows without address have none."""
    label = F.when(F.trim(ip) == "", UNKNOWN).otherwise(PENDING)
    return [label.alias("domestic"), label.alias("global")]


_SEEN = ["website_id", "source_id", "_sha1"]


def dedup_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Each line of a (site, source) once; the shuffle key holds the line's own hash, so no group grows large."""
    return lines.withColumn("_sha1", F.sha1(line)).dropDuplicates(_SEEN).drop("_sha1")


def dedup_stream(lines: DataFrame, line: str = "line", at: str = "received_at") -> DataFrame:
    """The same on a stream, remembering lines for ten minutes of event time."""
    span = f"{DEDUP_MINUTES} minutes"
    return (lines.withColumn("_sha1", F.sha1(line)).withWatermark(at, span)
            .dropDuplicatesWithinWatermark(_SEEN).drop("_sha1"))


def ingest_lines(batch: DataFrame, formats: dict[str, LineFormat], **options) -> DataFrame:
    """``(website_id, source_id, lines[])`` to parsed rows; duplicates are dropped before parsing.

    ``formats`` maps a source id to its format; sources that are not named use the entry ``""``.
    """
    single = dedup_lines(batch.select("website_id", "source_id", F.explode("lines").alias("line")))
    frames, known = [], [s for s in formats if s]
    for source, made in formats.items():
        mine = F.col("source_id") == source if source else ~F.col("source_id").isin(*known) if known else F.lit(True)
        frames.append(parse_lines(single.filter(mine), made, line="line", **options))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
