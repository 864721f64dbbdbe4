"""Registered queries: whitelist and geography.

The side tables (cache, queue, failures, ranges, answers, overrides) are derived from the whole test tables by the
same texts in both engines, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from visitmill.functions import places
from visitmill.operators import geo
from visitmill.operators import sessions as ss
from visitmill.operators import stats as st
from visitmill.operators import whitelist as wl
from visitmill.operators.ranges import match_ranges
from visitmill.plans.clock import epoch
from visitmill.plans.fixture import NOW, access_log, events
from visitmill.plans.oracle import over_log, sessions_of
from visitmill.plans.registry import Registry
from visitmill.plans.stat_queries import MONTH, S_BEFORE, ranked_sql

REG = Registry()
IPS = 251
NOW_TS = epoch(NOW)

AGG = """SELECT ip, min(id) AS k, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM access_log GROUP BY ip"""
CACHE = """SELECT ip, CASE WHEN k % 4 = 1 THEN '未知' ELSE '广东·深圳' END AS domestic,
 CASE WHEN k % 4 = 1 THEN '未知' ELSE '中国' END AS global, 'local' AS source, first_ts AS created_at,
 last_ts AS updated_at FROM addresses WHERE k % 4 <> 0"""
QUEUE = "SELECT ip, first_ts AS created_at, last_ts AS updated_at FROM addresses WHERE k % 3 <> 0"
FAILS = """SELECT id, ip, 'ip-api' AS source, CASE WHEN status_code = 404 THEN 'quota' ELSE 'request_error' END AS reason,
 concat('e', CAST(status_code AS STRING)) AS error, status_code, timestamp AS created_at FROM access_log
 WHERE status_code >= 400"""
OVER = """SELECT ip, '浙江·杭州·电信' AS domestic, '中国' AS global, concat('note ', ip) AS note, first_ts AS created_at,
 first_ts AS updated_at FROM addresses WHERE k % 5 = 0"""
ANSWERS = """SELECT ip, CASE WHEN k % 5 = 0 THEN 'fail' ELSE 'success' END AS status,
 CASE WHEN k % 10 = 0 THEN 'reserved range' ELSE '' END AS reason,
 CASE k % 6 WHEN 0 THEN '中国' WHEN 1 THEN ' China ' WHEN 2 THEN '日本' WHEN 3 THEN '0' WHEN 4 THEN '德国' ELSE '台湾' END
  AS country,
 CASE k % 6 WHEN 5 THEN 'CN' ELSE '' END AS country_code,
 CASE k % 6 WHEN 0 THEN '广东省' WHEN 1 THEN '上海市' WHEN 2 THEN '东京都' WHEN 5 THEN '' ELSE '未知' END AS region_name,
 CASE k % 6 WHEN 0 THEN '深圳市' WHEN 1 THEN '上海' WHEN 2 THEN '0' WHEN 4 THEN '柏林' ELSE '' END AS city
 FROM addresses WHERE k % 7 <> 0"""
# One range of eight addresses per nation, and one v6 block per region.
RANGES = """SELECT concat('00000000000000000000ffffcb0071', lpad(lower({hex}(n_nationkey * 10)), 2, '0')) AS lo,
 concat('00000000000000000000ffffcb0071', lpad(lower({hex}(n_nationkey * 10 + 7)), 2, '0')) AS hi,
 CASE n_nationkey % 5 WHEN 0 THEN '中国|0|广东省|深圳市|电信' WHEN 1 THEN '美国|0|加利福尼亚|0|0'
  WHEN 2 THEN '中国|浙江省|杭州市|联通|CN' WHEN 3 THEN '0|0|0|内网IP|内网IP' ELSE '中国|0|北京|北京市|移动' END AS region
 FROM nation UNION ALL
 SELECT concat('2001', lpad(lower({hex}(3512 + r_regionkey)), 4, '0'), repeat('0', 24)),
 concat('2001', lpad(lower({hex}(3512 + r_regionkey)), 4, '0'), repeat('f', 24)), '日本|0|东京|0|0' FROM region"""
DUCK_RANGES = RANGES.format(hex="to_hex")

S_KEY = """CASE WHEN ip LIKE '203.%' THEN concat('00000000000000000000ffffcb0071',
 lpad(lower(to_hex(CAST(split_part(ip, '.', 4) AS INT))), 2, '0'))
 WHEN ip = '2001:db8::1' THEN '20010db8000000000000000000000001' END"""
# domestic, global and has_city of the five region texts above.
_PLACE = {0: ("广东·深圳", "中国", "true"), 1: ("美国·加利福尼亚", "美国", "false"), 2: ("浙江·杭州", "中国", "true"),
          3: ("未知", "未知", "true"), 4: ("北京", "中国", "true")}


def _region_case(i: int) -> str:
    texts = ["中国|0|广东省|深圳市|电信", "美国|0|加利福尼亚|0|0", "中国|浙江省|杭州市|联通|CN", "0|0|0|内网IP|内网IP",
             "中国|0|北京|北京市|移动", "日本|0|东京|0|0"]
    values = {**_PLACE, 5: ("日本·东京", "日本", "false")}
    return "CASE region " + " ".join(
        f"WHEN '{t}' THEN {values[n][i] if i == 2 else chr(39) + values[n][i] + chr(39)}"
        for n, t in enumerate(texts)) + " END"


LOCATED = f"""SELECT a.ip, CASE WHEN a.ip LIKE '10.%' OR a.ip LIKE '192.168.%' THEN '内网'
  WHEN region IS NULL THEN '未知' ELSE {_region_case(0)} END AS domestic,
 CASE WHEN a.ip LIKE '10.%' OR a.ip LIKE '192.168.%' THEN '本地网络'
  WHEN region IS NULL THEN '未知' ELSE {_region_case(1)} END AS "global",
 CASE WHEN a.ip LIKE '10.%' OR a.ip LIKE '192.168.%' THEN true
  WHEN region IS NULL THEN false ELSE {_region_case(2)} END AS has_city,
 CASE WHEN a.ip LIKE '10.%' OR a.ip LIKE '192.168.%' THEN 'local' WHEN region IS NULL THEN 'unknown' ELSE 'local' END
  AS source FROM (SELECT ip, {S_KEY} AS ky FROM addresses) a LEFT JOIN ranges r ON a.ky BETWEEN r.lo AND r.hi"""
ANSWERED = """SELECT ip, status, reason, CASE k6 WHEN 0 THEN '广东·深圳' WHEN 1 THEN '上海' WHEN 2 THEN '日本·东京都'
  WHEN 3 THEN '未知' WHEN 4 THEN '德国·柏林' ELSE '台湾' END AS domestic,
 CASE k6 WHEN 0 THEN '中国' WHEN 1 THEN 'China' WHEN 2 THEN '日本' WHEN 3 THEN '未知' WHEN 4 THEN '德国' ELSE '台湾' END
  AS "global" FROM (SELECT a.*, CASE a.country WHEN '中国' THEN 0 WHEN ' China ' THEN 1 WHEN '日本' THEN 2
  WHEN '0' THEN 3 WHEN '德国' THEN 4 ELSE 5 END AS k6 FROM answers a)"""
CTES = {"addresses": AGG, "cache": CACHE, "queue": QUEUE, "failures": FAILS, "overrides": OVER, "answers": ANSWERS,
        "ranges": DUCK_RANGES, "located": LOCATED, "answered": ANSWERED}


class World:
    """The side tables as frames."""

    def __init__(self, spark, sf_dir):
        self.log = access_log(spark, sf_dir, IPS)

        def build(text, **frames):
            return spark.sql(text, **frames)

        def over(text, name, frame):
            return build(text.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: frame})

        self.addresses = over(AGG, "access_log", self.log)
        self.cache = over(CACHE, "addresses", self.addresses)
        self.queue = over(QUEUE, "addresses", self.addresses)
        self.overrides = over(OVER, "addresses", self.addresses)
        self.answers = over(ANSWERS, "addresses", self.addresses)
        self.failures = over(FAILS, "access_log", self.log)
        text = RANGES.format(hex="hex").replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}")
        self.ranges = build(text, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"),
                            region=spark.read.parquet(f"{sf_dir}/region.parquet"))


def q(name, build, body):
    ctes = [f"{n} AS ({t})" for n, t in CTES.items()]
    REG.add(name, lambda spark, sf: build(World(spark, sf)), over_log(body, *ctes, ips=IPS))


# ---- 2.3 whitelist ----------------------------------------------------------------------------------------------

RULES = wl.Whitelist(("203.0.113.5", "203.0.113.8/29", "203.0.113.20-203.0.113.22", "203.0.113.9", "bad/entry",
                      "2001:db8::/48"), ("深圳市",), True)
_FULL = " WHEN ".join([
    "CASE WHEN ip = '203.0.113.5' THEN 'ip|203.0.113.5'", "ip = '203.0.113.9' THEN 'ip|203.0.113.9'",
    "o BETWEEN 8 AND 15 THEN 'cidr|203.0.113.8/29'", "ip = '2001:db8::1' THEN 'cidr|2001:db8::/48'",
    "o BETWEEN 20 AND 22 THEN 'range|203.0.113.20-203.0.113.22'",
    "domestic = '广东·深圳' THEN 'city|深圳市'", "\"global\" IN ('美国', '日本') THEN 'non_mainland|非大陆' END"])
_OCTET = "CASE WHEN ip LIKE '203.%' THEN CAST(split_part(ip, '.', 4) AS INT) ELSE -1 END"


def _wl(name, rules, kinds, by_join=False):
    body = f"""SELECT id, ip, split_part(r, '|', 1) AS rule_type, split_part(r, '|', 2) AS rule_value FROM (
    SELECT *, {_FULL} AS r FROM (SELECT *, {_OCTET} AS o FROM access_log)) WHERE r IS NOT NULL"""
    if kinds:
        body = f"""SELECT id, ip, split_part(r, '|', 1) AS rule_type, split_part(r, '|', 2) AS rule_value FROM (
        SELECT *, {kinds} AS r FROM (SELECT *, {_OCTET} AS o FROM access_log)) WHERE r IS NOT NULL"""
    q(name, lambda w: wl.whitelist_match(w.log, rules, by_join).filter(F.col("rule_type").isNotNull())
      .select("id", "ip", "rule_type", "rule_value"), body)


_wl("whitelist_ip", wl.Whitelist(("203.0.113.5", "2001:0DB8::0001")),
    "CASE WHEN ip = '203.0.113.5' THEN 'ip|203.0.113.5' WHEN ip = '2001:db8::1' THEN 'ip|2001:db8::1' END")
_wl("whitelist_cidr", wl.Whitelist(("203.0.113.8/29", "10.0.0.0/8")),
    "CASE WHEN o BETWEEN 8 AND 15 THEN 'cidr|203.0.113.8/29' WHEN ip LIKE '10.%' THEN 'cidr|10.0.0.0/8' END")
_wl("whitelist_range", wl.Whitelist(("203.0.113.20-203.0.113.22", "9.9.9.9-1.1.1.1", "1.1.1.1-::2")),
    "CASE WHEN o BETWEEN 20 AND 22 THEN 'range|203.0.113.20-203.0.113.22' END")
_wl("whitelist_city", wl.Whitelist((), ("深圳市", "杭州")),
    "CASE WHEN domestic = '广东·深圳' THEN 'city|深圳市' WHEN domestic = '浙江·杭州' THEN 'city|杭州' END")
_wl("whitelist_non_mainland", wl.Whitelist((), (), True),
    "CASE WHEN \"global\" IN ('美国', '日本') THEN 'non_mainland|非大陆' END")
_wl("whitelist_first_match", RULES, None)
# Long lists can be looked up per distinct address instead.
MANY = wl.Whitelist(tuple(f"203.0.{i // 128}.{(i % 128) * 2}" for i in range(128 * 114)))
_wl("whitelist_long_list", MANY, "CASE WHEN o >= 0 AND o % 2 = 0 THEN concat('ip|', ip) END", by_join=True)
_wl("whitelist_by_join", RULES, None, by_join=True)
q("whitelist_hits", lambda w: wl.whitelist_hits(wl.whitelist_match(w.log, RULES), "a1b2", "Main"),
  f"""SELECT concat('whitelist:a1b2:', rule_type, ':', rule_value, ':', ip) AS fingerprint, rule_type, rule_value, ip,
  count(*) AS occurrences, first(timestamp ORDER BY timestamp, id) AS timestamp, first(url ORDER BY timestamp, id) AS url,
  first(method ORDER BY timestamp, id) AS method, first(status_code ORDER BY timestamp, id) AS status_code,
  first(d ORDER BY timestamp, id) AS domestic, first(g ORDER BY timestamp, id) AS "global",
  concat('站点 Main · IP ', ip, ' 命中', CASE rule_type WHEN 'ip' THEN 'IP: ' WHEN 'city' THEN '城市: '
  WHEN 'non_mainland' THEN '非大陆访问' ELSE 'IP 段: ' END, CASE WHEN rule_type = 'non_mainland' THEN '' ELSE rule_value END,
  CASE WHEN first(d ORDER BY timestamp, id) = '' THEN '' ELSE concat(' · 位置 ', first(d ORDER BY timestamp, id), ' / ',
  first(g ORDER BY timestamp, id)) END) AS message
  FROM (SELECT *, split_part(r, '|', 1) AS rule_type, split_part(r, '|', 2) AS rule_value,
   CASE WHEN split_part(r, '|', 1) IN ('city', 'non_mainland') THEN domestic ELSE '' END AS d,
   CASE WHEN split_part(r, '|', 1) IN ('city', 'non_mainland') THEN "global" ELSE '' END AS g
   FROM (SELECT *, {_FULL} AS r FROM (SELECT *, {_OCTET} AS o FROM access_log)) WHERE r IS NOT NULL)
  GROUP BY rule_type, rule_value, ip""")

# ---- 2.9 geography ----------------------------------------------------------------------------------------------

q("geo_lookup", lambda w: geo.geo_lookup(w.log, w.ranges), "SELECT * FROM located")
# One v6 network holds all addresses: a block per supplier in it, and blocks of parts inside and between those.
_CELL = "concat('20010db8', lpad(lower({hex}(%s)), 8, '0'), %s)"
_LOW, _HIGH = "repeat('0', 16)", "repeat('f', 16)"
_OWNERS = f"""SELECT {_CELL % ("s_suppkey * 50", _LOW)} AS lo, {_CELL % ("s_suppkey * 50 + 39", _HIGH)} AS hi, concat('s', CAST(s_suppkey AS STRING)) AS owner
 FROM supplier UNION ALL SELECT {_CELL % ("p_partkey * 10 + 3", _LOW)}, {_CELL % ("p_partkey * 10 + 3", _HIGH)}, concat('p', CAST(p_partkey AS STRING))
 FROM part UNION ALL SELECT concat('2001', repeat('0', 28)), concat('2001', repeat('f', 28)), concat('r', CAST(r_regionkey AS STRING))
 FROM region WHERE r_regionkey = 2"""
_HOSTS = f"SELECT o_orderkey, {_CELL % ('o_custkey * 3', 'lpad(lower({hex}(o_orderkey)), 16, ' + chr(39) + '0' + chr(39) + ')')} AS ip_key FROM orders"


def _nested_ranges(spark, sf):
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("supplier", "part", "region", "orders")}

    def build(text, *names):
        for n in names:
            text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
        return spark.sql(text.replace("{hex}", "hex"), **{n: frames[n] for n in names})
    return match_ranges(build(_HOSTS, "orders"), build(_OWNERS, "supplier", "part", "region"), "owner")


REG.add("geo_nested_ranges", _nested_ranges, f"""WITH hosts AS ({_HOSTS}), owners AS ({_OWNERS}),
 cells AS (SELECT substr(ip_key, 9, 8) AS cell, min(ip_key) AS ip_key FROM hosts GROUP BY 1),
 inner_most AS (SELECT c.cell, max_by(owner, lo) AS owner FROM cells c JOIN owners o ON c.ip_key BETWEEN o.lo AND o.hi GROUP BY c.cell)
 SELECT o_orderkey, ip_key, owner FROM hosts LEFT JOIN inner_most ON cell = substr(ip_key, 9, 8)""".replace("{hex}", "to_hex"))
q("geo_format_api", lambda w: geo.geo_format_api(w.answers), 'SELECT ip, domestic, "global" FROM answered')

_REGIONS = [("中国|0|广东省|深圳市|电信", "广东·深圳", "中国"), ("中国|0|0|0|0", "中国", "中国"),
            ("中国|广东省|广州市|移动|CN", "广东·广州", "中国"), ("中国|0|0|苏州市|0", "苏州", "中国"),
            ("中国|0|上海市|上海市|联通", "上海", "中国"), ("中国|0|广西壮族自治区|电信|0", "广西壮族", "中国"),
            ("美国|0|0|纽约|0", "美国·纽约", "美国"), ("0|0|0|0|0", "未知", "未知"), ("", "未知", "未知"),
            ("日本|东京", "日本", "日本"), ("中国|0|市|0|0", "市", "中国")]


def _cycle(values):
    return f"CASE id % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


q("geo_parse_region", lambda w: places.parse_region(w.log.select("id", F.expr(
    _cycle([r[0] for r in _REGIONS])).alias("region"))).select("id", "domestic", "global"),
  f"""SELECT id, {_cycle([r[1] for r in _REGIONS])} AS domestic, {_cycle([r[2] for r in _REGIONS])} AS "global"
  FROM access_log""")

# Fixed values of the normalisation check: label, country, stored label.
_NORMAL = [("Tokyo", "Japan", "Tokyo"), ("广东·深圳·电信", "中国", "广东·深圳"), ("电信", "china", "中国"),
           ("腾讯云·广东深圳", "中国", "广东"), ("阿里云", "中国", "机房"), ("腾讯云南京", "中国", "机房"),
           ("北京·北京", "中国", "北京"), ("", "中国", ""), (" 浙江·联通- ", "China", "浙江"), ("0·未知", "中国", "中国"),
           ("中国内蒙古自治区/移动机房", "中国", "内蒙古"), ("(上海)·[AWS]", "中国", "上海")]
q("geo_normalize", lambda w: geo.geo_normalize(w.log.select(
    "id", F.expr(_cycle([n[0] for n in _NORMAL])).alias("domestic"),
    F.expr(_cycle([n[1] for n in _NORMAL])).alias("global"))),
  f"""SELECT id, {_cycle([n[2] for n in _NORMAL])} AS domestic, {_cycle([n[1] for n in _NORMAL])} AS "global"
  FROM access_log""")
q("geo_mark_pending", lambda w: geo.geo_mark_pending(w.log.withColumn(
    "ip", F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("ip")))).select("id", "domestic", "global"),
  """SELECT id, CASE WHEN id % 9 = 0 THEN '未知' ELSE '待解析' END AS domestic,
  CASE WHEN id % 9 = 0 THEN '未知' ELSE '待解析' END AS "global" FROM access_log""")
q("geo_enqueue", lambda w: geo.geo_enqueue(w.log, w.cache, w.queue, NOW_TS)[0],
  f"""SELECT ip, CASE WHEN q.ip IS NULL THEN {NOW_TS} ELSE q.created_at END AS created_at,
  CASE WHEN k % 4 IN (0, 1) THEN {NOW_TS} ELSE q.updated_at END AS updated_at
  FROM addresses LEFT JOIN queue q USING (ip) WHERE k % 4 IN (0, 1) OR q.ip IS NOT NULL""".replace(
      "q.ip", "q.updated_at"))
q("geo_enqueue_cache", lambda w: geo.geo_enqueue(w.log, w.cache, w.queue, NOW_TS)[1],
  "SELECT * FROM cache WHERE NOT (domestic = '未知' AND \"global\" = '未知')")
_RECENT = NOW_TS - 24 * 3600
q("geo_pending_batch", lambda w: geo.geo_pending_batch(w.queue, w.failures, _RECENT, 40),
  f"""SELECT * FROM queue q WHERE NOT EXISTS (SELECT 1 FROM failures f WHERE f.ip = q.ip
  AND f.created_at >= {_RECENT - 12 * 3600}) ORDER BY updated_at, ip LIMIT 40""")
q("geo_recover_pending", lambda w: geo.geo_recover_pending(w.log, 1000),
  """SELECT DISTINCT ip FROM access_log WHERE domestic = '待解析' AND "global" = '待解析' ORDER BY ip LIMIT 1000""")
_RESOLVED = """resolved AS (SELECT q.ip, CASE
  WHEN c.ip IS NOT NULL THEN 'c' WHEN l.source = 'local' AND l.has_city AND l.domestic <> '未知' THEN 'l'
  WHEN a.status = 'success' THEN 'r' WHEN l.source = 'local' AND l.domestic <> '未知' THEN 'l'
  WHEN a.status IS NOT NULL THEN 'f' ELSE 'u' END AS way, c.domestic AS cd, c."global" AS cg, c.source AS cs,
  l.domestic AS ld, l."global" AS lg, a.domestic AS rd, a."global" AS rg, a.reason AS rr
  FROM queue q LEFT JOIN (SELECT * FROM cache WHERE domestic <> '未知') c ON c.ip = q.ip
  LEFT JOIN located l ON l.ip = q.ip LEFT JOIN answered a ON a.ip = q.ip)"""
CTES["resolved"] = _RESOLVED[len("resolved AS ("):-1]
q("geo_resolve", lambda w: geo.geo_resolve(w.queue, w.cache, w.ranges, w.answers),
  """SELECT ip, CASE way WHEN 'c' THEN cd WHEN 'l' THEN ld WHEN 'r' THEN rd WHEN 'u' THEN '未知' END AS domestic,
  CASE way WHEN 'c' THEN cg WHEN 'l' THEN lg WHEN 'r' THEN rg WHEN 'u' THEN '未知' END AS "global",
  CASE way WHEN 'c' THEN cs WHEN 'l' THEN 'local' WHEN 'r' THEN 'remote' WHEN 'u' THEN 'unknown' END AS source,
  CASE way WHEN 'c' THEN 'cached' WHEN 'f' THEN 'failed' ELSE 'fetched' END AS outcome,
  CASE WHEN way = 'f' THEN CASE WHEN trim(rr) = '' THEN 'unknown' ELSE rr END END AS reason FROM resolved""")


def _entries(w):
    return w.overrides.select("ip", "domestic", "global", F.when(F.length("ip") % 2 == 0, " ")
                              .otherwise("remote").alias("source"))


q("geo_cache_upsert", lambda w: geo.geo_cache_upsert(w.cache, _entries(w), NOW_TS),
  f"""SELECT coalesce(o.ip, c.ip) AS ip, CASE WHEN o.ip IS NULL THEN c.domestic ELSE '浙江·杭州' END AS domestic,
  CASE WHEN o.ip IS NULL THEN c."global" ELSE '中国' END AS "global",
  CASE WHEN o.ip IS NULL THEN c.source WHEN length(o.ip) % 2 = 0 THEN 'unknown' ELSE 'remote' END AS source,
  coalesce(c.created_at, {NOW_TS}) AS created_at, CASE WHEN o.ip IS NULL THEN c.updated_at ELSE {NOW_TS} END AS updated_at
  FROM cache c FULL JOIN overrides o ON o.ip = c.ip""")
q("geo_cache_trim", lambda w: geo.geo_cache_trim(w.cache, 50),
  "SELECT * FROM cache ORDER BY created_at DESC, ip LIMIT 50")
_PLACES = ["id", "ip", "domestic", "global"]
_WAIT = "l.domestic = '待解析' AND l.\"global\" = '待解析'"
q("geo_backfill", lambda w: geo.geo_backfill(w.log, w.cache.filter(~geo._unknown())).select(*_PLACES),
  f"""SELECT l.id, l.ip, CASE WHEN {_WAIT} AND c.ip IS NOT NULL THEN c.domestic ELSE l.domestic END AS domestic,
  CASE WHEN {_WAIT} AND c.ip IS NOT NULL THEN c."global" ELSE l."global" END AS "global" FROM access_log l
  LEFT JOIN (SELECT * FROM cache WHERE domestic <> '未知') c ON c.ip = l.ip""")
q("geo_remark_pending", lambda w: geo.geo_remark_pending(w.log, w.overrides).select(*_PLACES),
  """SELECT l.id, l.ip, CASE WHEN o.ip IS NULL THEN l.domestic ELSE '待解析' END AS domestic,
  CASE WHEN o.ip IS NULL THEN l."global" ELSE '待解析' END AS "global" FROM access_log l LEFT JOIN overrides o
  ON o.ip = l.ip""")
q("geo_effective", lambda w: geo.geo_effective(w.log, w.overrides, w.cache),
  """SELECT a.ip, coalesce(o.domestic, c.domestic, '待解析') AS domestic, coalesce(o."global", c."global", '待解析')
  AS "global", CASE WHEN o.ip IS NOT NULL THEN 'manual' ELSE coalesce(c.source, 'pending') END AS source,
  o.ip IS NOT NULL AS is_manual, coalesce(o.note, '') AS note FROM addresses a LEFT JOIN overrides o ON o.ip = a.ip
  LEFT JOIN cache c ON c.ip = a.ip""")
q("geo_apply_override", lambda w: geo.geo_apply_override(w.log, w.overrides).select(*_PLACES),
  """SELECT l.id, l.ip, CASE WHEN o.ip IS NULL THEN l.domestic ELSE '浙江·杭州' END AS domestic,
  CASE WHEN o.ip IS NULL THEN l."global" ELSE '中国' END AS "global" FROM access_log l LEFT JOIN overrides o
  ON o.ip = l.ip""")


def _counts(w):
    log = w.log.withColumn("website_id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
    return geo.geo_override_counts(log, ss.sessionize(log), w.overrides)



for _n in range(3):
    CTES[f"part{_n}"] = f"SELECT * FROM access_log WHERE id % 3 = {_n}"
q("geo_override_counts", _counts,
  "SELECT o.ip, count(l.id) AS logs, (SELECT count(*) FROM (" + " UNION ALL ".join(
      f"SELECT ip FROM (WITH {sessions_of(f'part{n}', f'runs{n}')} SELECT ip FROM runs{n})" for n in range(3))
  + ") s WHERE s.ip = o.ip) AS sessions, count(DISTINCT l.id % 3) AS sites FROM overrides o "
    "LEFT JOIN access_log l ON l.ip = o.ip GROUP BY o.ip")


def _new_overrides(w):
    return w.addresses.filter("k % 3 = 0").select(
        F.concat(F.lit(" "), "ip").alias("ip"), F.lit("上海").alias("domestic"),
        F.when(F.length("ip") == 12, " ").otherwise("中国").alias("global"), F.lit("").alias("note"))


q("geo_override_upsert", lambda w: geo.geo_override_upsert(w.overrides, _new_overrides(w), NOW_TS),
  f"""SELECT coalesce(n.ip, o.ip) AS ip, CASE WHEN n.ip IS NULL THEN o.domestic ELSE '上海' END AS domestic,
  '中国' AS "global", CASE WHEN n.ip IS NULL THEN o.note ELSE '' END AS note, coalesce(o.created_at, {NOW_TS}) AS created_at,
  CASE WHEN n.ip IS NULL THEN o.updated_at ELSE {NOW_TS} END AS updated_at FROM overrides o FULL JOIN
  (SELECT ip FROM addresses WHERE k % 3 = 0 AND length(ip) <> 12) n ON n.ip = o.ip""")
q("geo_override_delete", lambda w: geo.geo_override_delete(w.overrides, w.queue),
  "SELECT * FROM overrides WHERE ip NOT IN (SELECT ip FROM queue)")
q("geo_failures", lambda w: geo.geo_failures(w.failures, w.log.filter("timestamp < 1704672000"), "quota", "113.1", 2, 20),
  """SELECT id, ip, source, reason, error, status_code, created_at, (SELECT count(*) FROM picked) > 40 AS has_more
  FROM picked ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""".replace("picked", """(SELECT * FROM failures
  WHERE reason = 'quota' AND contains(ip, '113.1') AND ip IN (SELECT ip FROM access_log WHERE timestamp < 1704672000))"""))
q("geo_failures_clear", lambda w: geo.geo_failures_clear(w.failures, None, "quota", "113.1"),
  "SELECT * FROM failures WHERE NOT (reason = 'quota' AND contains(ip, '113.1'))")


def _province(log):
    """Province names in full, as some sources write them."""
    return log.withColumn("domestic", F.regexp_replace("domestic", "^(广东|浙江)", "$1省"))


q("geo_map_rows", lambda w: geo.geo_map_rows(st.location_stats(_province(w.log), MONTH, "domestic", 99)),
  f"""SELECT "key" AS name, uv AS value, uv_percent AS percentage FROM ({ranked_sql(S_BEFORE, '"global" = ' + "'中国'", 99)})
  WHERE "key" NOT IN ('待解析', '未知', '')""")
q("geo_map_world", lambda w: geo.geo_map_rows(st.location_stats(w.log, MONTH, "global", 99), china=False),
  f"""SELECT "key" AS name, uv AS value, uv_percent AS percentage FROM ({ranked_sql('"global"', "TRUE", 99)})
  WHERE "key" NOT IN ('待解析', '未知', '')""")
