"""Whitelist matching: address rules, then city rules, then the non-mainland rule; first match wins.

Rules are site configuration, known on the driver. Address rules are laid out as disjoint ranges once. Up to a few
hundred ranges become a binary-search expression evaluated per row, without any shuffle; longer lists are looked up
for distinct addresses only.
"""

from __future__ import annotations

import dataclasses
import heapq
import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.functions.net import clean_ip, ip_key
from visitmill.functions.places import comparable, is_non_mainland, rule_text
from visitmill.operators.ranges import match_ranges
from visitmill.operators.shared import lookup
from visitmill.schema import PENDING, UNKNOWN

# Rule kinds by precedence, their names in messages, and texts.
KINDS = ["ip", "cidr", "range", "city", "non_mainland"]
KIND_LABELS = {"ip": "IP", "cidr": "IP 段", "range": "IP 段", "city": "城市", "non_mainland": "非大陆访问"}
NON_MAINLAND_VALUE = "非大陆"
TITLE = "白名单命中"


@dataclasses.dataclass(frozen=True)
class Whitelist:
    """``ips`` may mix addresses, CIDR blocks and ``a-b`` ranges; entries that are none of these are ignored."""

    ips: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    non_mainland: bool = False

    def address_rules(self) -> list[tuple[int, int, int, str, str]]:
        """(precedence, lowest, highest, kind, label) on the 128-bit address line."""
        out = []
        for text in (t.strip() for t in self.ips):
            try:
                if "/" in text:
                    net = ipaddress.ip_network(text, strict=False)
                    kind, low, high = "cidr", net[0], net[-1]
                elif "-" in text:
                    low, high = (ipaddress.ip_address(p.strip()) for p in text.split("-", 1))
                    kind = "range"
                else:
                    low = high = ipaddress.ip_address(text)
                    kind, text = "ip", str(low)
            except ValueError:
                continue
            if low.version == high.version and low <= high:
                out.append((KINDS.index(kind) * len(self.ips) + len(out), _line(low), _line(high), kind, text))
        return out

    def segments(self) -> list[tuple[int, int, str, str]]:
        """Disjoint ranges with the winning rule of each."""
        rules = sorted(self.address_rules(), key=lambda r: r[1])
        edges = sorted({r[1] for r in rules} | {r[2] + 1 for r in rules})
        out, open_rules, at = [], [], 0
        for low, after in zip(edges, edges[1:]):
            while at < len(rules) and rules[at][1] <= low:
                heapq.heappush(open_rules, rules[at])
                at += 1
            while open_rules and open_rules[0][2] < low:
                heapq.heappop(open_rules)
            if open_rules:
                out.append((low, after - 1, open_rules[0][3], open_rules[0][4]))
        return out


def _line(address) -> int:
    return int(address) + (0xFFFF << 32 if address.version == 4 else 0)


def _tag(kind: str, label: str) -> str:
    return f"{kind}\t{label}"


def _search(key: Column, segments: list) -> Column:
    """Nested halves: a key is compared with about log2(n) bounds."""
    if len(segments) == 1:
        low, high, kind, label = segments[0]
        return F.when(key.between(f"{low:032x}", f"{high:032x}"), _tag(kind, label))
    middle = len(segments) // 2
    return F.when(key < f"{segments[middle][0]:032x}", _search(key, segments[:middle])).otherwise(
        _search(key, segments[middle:]))


def _location_rule(rules: Whitelist) -> Column:
    """City rules in order, then the non-mainland rule; rows without a known location match neither."""
    place = F.col("_place")
    out = F.when(is_non_mainland("domestic", "global"), _tag("non_mainland", NON_MAINLAND_VALUE)) \
        if rules.non_mainland else F.lit(None).cast("string")
    for city in reversed(rules.cities):
        text = rule_text(city)
        if text:
            out = F.when(place.contains(text), _tag("city", city.strip())).otherwise(out)
    known = ~F.col("domestic").isin("", UNKNOWN, PENDING) & ~F.col("global").isin("", UNKNOWN, PENDING)
    return F.when(known, out)


def whitelist_match(log: DataFrame, rules: Whitelist, by_join: bool = False) -> DataFrame:
    """Adds ``rule_type`` and ``rule_value``: NULL where nothing matches.

    Address rules are a search expression in each row; ``by_join`` looks the distinct addresses up in a table of the rules
    instead, which suits lists of thousands. Both give the same rows.
    """
    segments = rules.segments()
    if not segments:
        rows = log.withColumn("_rule", F.lit(None).cast("string"))
    elif not by_join:
        rows = log.withColumn("_k", ip_key(clean_ip("ip"))).withColumn("_rule", _search(F.col("_k"), segments))
    else:
        spark = log.sparkSession
        table = spark.createDataFrame(
            [(f"{a:032x}", f"{b:032x}", _tag(kind, label)) for a, b, kind, label in segments],
            "lo string, hi string, _rule string")
        addresses = log.select("ip").distinct().withColumn("ip_key", ip_key(clean_ip("ip")))
        hits = match_ranges(addresses.filter(F.col("ip_key").isNotNull()), table, "_rule")
        rows = lookup(log, hits.filter(F.col("_rule").isNotNull()).select("ip", "_rule"), "ip")
    if rules.cities:
        rows = rows.withColumn("_place", comparable("domestic"))
    # Through a one-element array, so that a filter on the rule is not rewritten into the whole rule search.
    found = F.explode(F.array(F.coalesce(F.col("_rule"), _location_rule(rules))))
    return rows.select(*log.columns, found.alias("_rule")).select(
        *log.columns, F.split_part("_rule", F.lit("\t"), F.lit(1)).alias("rule_type"),
        F.split_part("_rule", F.lit("\t"), F.lit(2)).alias("rule_value"))


def whitelist_hits(matched: DataFrame, website_id: str, site_name: str = "") -> DataFrame:
    """One row per (site, rule, address): hit count, first log, message. ``matched`` is a whitelist_match result."""
    hits = matched.filter(F.col("rule_type").isNotNull())
    located = F.col("rule_type").isin("city", "non_mainland")
    first = F.struct("timestamp", "url", "method", "status_code",
                     F.when(located, F.col("domestic")).otherwise("").alias("domestic"),
                     F.when(located, F.col("global")).otherwise("").alias("global"))
    grouped = hits.groupBy("rule_type", "rule_value", "ip").agg(
        F.count("*").alias("occurrences"), F.min_by(first, F.struct("timestamp", "id")).alias("first"))
    label = F.lit(KIND_LABELS["ip"])
    for kind, text in KIND_LABELS.items():
        label = F.when(F.col("rule_type") == kind, text).otherwise(label)
    value = F.when(F.col("rule_type") == "non_mainland", "").otherwise(F.concat(F.lit(": "), F.col("rule_value")))
    place, land = F.trim(F.col("first.domestic")), F.trim(F.col("first.global"))
    where = F.array_join(F.filter(F.array(place, land), lambda p: p != ""), " / ")
    site = f"站点 {site_name} · " if site_name else ""
    message = F.concat(F.lit(f"{site}IP "), F.col("ip"), F.lit(" 命中"), label, value,
                       F.when(where != "", F.concat(F.lit(" · 位置 "), where)).otherwise(""))
    fingerprint = F.concat_ws(":", F.lit("whitelist"), F.lit(website_id), "rule_type", "rule_value", "ip")
    return grouped.select(
        fingerprint.alias("fingerprint"), "rule_type", "rule_value", "ip", "occurrences",
        F.col("first.timestamp").alias("timestamp"), F.col("first.url").alias("url"),
        F.col("first.method").alias("method"), F.col("first.status_code").alias("status_code"),
        F.col("first.domestic").alias("domestic"), F.col("first.global").alias("global"), message.alias("message"))
