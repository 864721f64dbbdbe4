"""Locations of addresses: lookup, cache, queue, failures, manual overrides, and their way back into the facts.

Tables: cache (ip, domestic, global, source, created_at, updated_at), pending (ip, created_at, updated_at),
failures (id, ip, source, reason, error, status_code, created_at), overrides (ip, domestic, global, note,
created_at, updated_at), ranges (lo, hi, region; disjoint; 32 hex digits), answers (ip, status, reason, country,
country_code, region_name, city). Times are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.functions.net import ip_key, is_private_key
from visitmill.functions.places import (format_answer, is_hidden, normalize_place, parse_region, province_label)
from visitmill.operators.parse import pending_location
from visitmill.operators.paging import Cursor, first_rows, page_and_more
from visitmill.operators.ranges import match_ranges
from visitmill.operators.shared import lookup
from visitmill.schema import GEO_COOLDOWN_HOURS, PENDING, UNKNOWN

# Labels of local and private addresses.
LOCAL = ("本地", "本地")
PRIVATE = ("内网", "本地网络")
LOCAL_ADDRESSES = ["localhost", "127.0.0.1", "::1"]


def _unknown(prefix: str = "") -> Column:
    return (F.col(f"{prefix}domestic") == UNKNOWN) & (F.col(f"{prefix}global") == UNKNOWN)


def _usable(prefix: str = "") -> Column:
    return ~F.col(f"{prefix}domestic").isin("", UNKNOWN) & ~F.col(f"{prefix}global").isin("", UNKNOWN)


def _latest(union: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    return union.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(key, "_v.*")


# ---- lookup -----------------------------------------------------------------------------------------------------

def geo_lookup(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Location of each distinct address: local and private labels first, then the range table."""
    keyed = ips.select(F.trim("ip").alias("ip")).distinct().withColumn("ip_key", ip_key("ip"))
    local, private = F.col("ip").isin(*LOCAL_ADDRESSES), is_private_key(F.col("ip_key"))
    # Only public addresses take part in the range search.
    public = F.col("ip_key").isNotNull() & ~local & ~private
    found = parse_region(match_ranges(keyed.filter(public), ranges, "region"))
    hit = F.col("region").isNotNull()
    searched = found.select("ip", F.when(hit, F.col("domestic")).otherwise(UNKNOWN).alias("domestic"),
                            F.when(hit, F.col("global")).otherwise(UNKNOWN).alias("global"),
                            F.coalesce(hit & F.col("has_city"), F.lit(False)).alias("has_city"),
                            F.when(hit, "local").otherwise("unknown").alias("source"))
    fixed = keyed.filter(~F.coalesce(public, F.lit(False))).select(
        "ip",
        F.when(local, LOCAL[0]).when(private, PRIVATE[0]).otherwise(UNKNOWN).alias("domestic"),
        F.when(local, LOCAL[1]).when(private, PRIVATE[1]).otherwise(UNKNOWN).alias("global"),
        (local | F.coalesce(private, F.lit(False))).alias("has_city"),
        F.when(local | private, "local").otherwise("invalid").alias("source"))
    return searched.unionByName(fixed)


def geo_format_api(answers: DataFrame) -> DataFrame:
    return answers.select("ip", *format_answer("country", "country_code", "region_name", "city"))


def geo_mark_pending(log: DataFrame) -> DataFrame:
    labels = dict(zip(("domestic", "global"), pending_location("ip")))
    return log.withColumns(labels)


# ---- queue ------------------------------------------------------------------------------------------------------

def geo_enqueue(log: DataFrame, cache: DataFrame, pending: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(pending, cache) after a batch: addresses without usable cache entry are queued or touched; cache entries
    of the batch that only say "unknown" are removed."""
    ips = log.select(F.trim("ip").alias("ip")).filter(F.col("ip") != "").distinct()
    missing = ips.join(cache.filter(~_unknown()), "ip", "left_anti")
    fresh = missing.select("ip", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    queue = pending.unionByName(fresh).groupBy("ip").agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    kept = cache.filter(~_unknown()).unionByName(cache.filter(_unknown()).join(ips, "ip", "left_anti"))
    return queue, kept


def geo_pending_batch(pending: DataFrame, failures: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Addresses without a failure in the last 12 hours; with ``limit``, those that wait longest."""
    recent = failures.filter(F.col("created_at") >= now - GEO_COOLDOWN_HOURS * 3600).select("ip").distinct()
    able = pending.join(recent, "ip", "left_anti")
    return able if limit is None else able.orderBy("updated_at", "ip").limit(limit)


def geo_recover_pending(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Addresses whose facts still wait for a location; with ``limit``, the first by address."""
    waiting = log.filter((F.col("domestic") == PENDING) & (F.col("global") == PENDING) & (F.trim("ip") != ""))
    found = waiting.select(F.trim("ip").alias("ip")).distinct()
    return found if limit is None else found.orderBy("ip").limit(limit)


def geo_resolve(batch: DataFrame, cache: DataFrame, ranges: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per queued address with its location, source and outcome.

    ``outcome``: ``cached``, ``fetched`` (to be cached) or ``failed`` (stays queued, goes to the failure table with
    ``reason``). A range hit with a city is final; without a city the service's answer is preferred.
    """
    ips = batch.select("ip").distinct()
    local = geo_lookup(ips, ranges).select("ip", *[F.col(c).alias(f"l_{c}") for c in
                                                   ("domestic", "global", "has_city", "source")])
    remote = answers.select("ip", F.col("status").alias("r_status"), F.col("reason").alias("r_reason"),
                            *[c.alias(f"r_{n}") for n, c in zip(("domestic", "global"), format_answer(
                                "country", "country_code", "region_name", "city"))])
    known = cache.filter(~_unknown()).select("ip", *[F.col(c).alias(f"c_{c}") for c in ("domestic", "global", "source")])
    row = ips.join(known, "ip", "left").join(local, "ip", "left").join(remote, "ip", "left")
    cached = F.col("c_domestic").isNotNull()
    final = (F.col("l_source") == "invalid") | ((F.col("l_source") == "local") & F.col("l_has_city") & _usable("l_"))
    answered = F.coalesce(F.col("r_status") == "success", F.lit(False))
    fallback = (F.col("l_source") == "local") & _usable("l_")
    refused = F.coalesce(F.col("r_status") != "success", F.lit(False))

    def pick(name: str, unknown: str) -> Column:
        remote_value = F.lit("remote") if name == "source" else F.col(f"r_{name}")
        return (F.when(cached, F.col(f"c_{name}")).when(final, F.col(f"l_{name}")).when(answered, remote_value)
                .when(fallback, F.col(f"l_{name}")).when(refused, F.lit(None)).otherwise(unknown))

    failed = ~cached & ~final & ~answered & ~fallback & refused
    return row.select(
        "ip", pick("domestic", UNKNOWN).alias("domestic"), pick("global", UNKNOWN).alias("global"),
        pick("source", "unknown").alias("source"),
        F.when(cached, "cached").when(failed, "failed").otherwise("fetched").alias("outcome"),
        F.when(failed, F.when(F.trim("r_reason") == "", "unknown").otherwise(F.col("r_reason"))).alias("reason"))


# ---- cache ------------------------------------------------------------------------------------------------------

def geo_normalize(places: DataFrame) -> DataFrame:
    return normalize_place(places)


def geo_cache_upsert(cache: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Entries win over cached rows; the first creation time is kept."""
    clean = normalize_place(entries.filter(F.col("ip") != "")).select(
        "ip", "domestic", "global",
        F.when(F.trim("source") == "", "unknown").otherwise(F.trim("source")).alias("source"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(1).alias("_new"))
    both = cache.withColumn("_new", F.lit(0)).unionByName(clean)
    values = ["domestic", "global", "source", "updated_at"]
    out = both.groupBy("ip").agg(F.max_by(F.struct(*values), "_new").alias("_v"), F.min("created_at").alias("created_at"))
    return out.select("ip", "_v.domestic", "_v.global", "_v.source", "created_at", "_v.updated_at")


def geo_cache_trim(cache: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` entries by creation time. Many entries are kept where they are, up to a last one found by selection."""
    return first_rows(cache, [("created_at", True), ("ip", False)], limit)


# ---- facts ------------------------------------------------------------------------------------------------------

def geo_backfill(rows: DataFrame, places: DataFrame, spread: str = "id") -> DataFrame:
    """Waiting locations of facts or sessions replaced by known ones. Only waiting rows take part in the join."""
    waiting = (F.col("domestic") == PENDING) & (F.col("global") == PENDING)
    new = normalize_place(places.select("ip", "domestic", "global")).select(
        "ip", F.col("domestic").alias("_d"), F.col("global").alias("_g"))
    filled = lookup(rows.filter(waiting), new, "ip", spread=spread).withColumns({
        "domestic": F.coalesce("_d", "domestic"), "global": F.coalesce("_g", "global")})
    return rows.filter(~waiting).unionByName(filled.select(*rows.columns))


def geo_remark_pending(rows: DataFrame, ips: DataFrame, spread: str = "id") -> DataFrame:
    """Locations of the given addresses reset to waiting."""
    marks = ips.select(F.trim("ip").alias("ip")).filter(F.col("ip") != "").distinct().withColumn("_hit", F.lit(True))
    joined = lookup(rows, marks, "ip", spread=spread)
    return joined.withColumns({
        c: F.when(F.col("_hit"), PENDING).otherwise(F.col(c)) for c in ("domestic", "global")}).select(*rows.columns)


def geo_effective(ips: DataFrame, overrides: DataFrame, cache: DataFrame) -> DataFrame:
    """Manual override, else cache, else waiting."""
    o = overrides.select("ip", *[F.col(c).alias(f"o_{c}") for c in ("domestic", "global", "note")])
    c = cache.select("ip", *[F.col(x).alias(f"c_{x}") for x in ("domestic", "global", "source")])
    row = ips.select(F.trim("ip").alias("ip")).filter(F.col("ip") != "").distinct().join(o, "ip", "left").join(c, "ip", "left")
    manual = F.col("o_domestic").isNotNull()
    return row.select(
        "ip", F.coalesce("o_domestic", "c_domestic", F.lit(PENDING)).alias("domestic"),
        F.coalesce("o_global", "c_global", F.lit(PENDING)).alias("global"),
        F.when(manual, "manual").otherwise(F.coalesce("c_source", F.lit("pending"))).alias("source"),
        F.coalesce(manual, F.lit(False)).alias("is_manual"), F.coalesce("o_note", F.lit("")).alias("note"))


def geo_apply_override(rows: DataFrame, overrides: DataFrame, spread: str = "id") -> DataFrame:
    """Locations of overridden addresses replaced everywhere, in facts or sessions."""
    new = normalize_place(overrides.select("ip", "domestic", "global")).select(
        "ip", F.col("domestic").alias("_d"), F.col("global").alias("_g"))
    joined = lookup(rows, new, "ip", spread=spread)
    return joined.withColumns({
        "domestic": F.coalesce("_d", "domestic"), "global": F.coalesce("_g", "global")}).select(*rows.columns)


def geo_override_counts(log: DataFrame, sessions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Facts, sessions and sites an override touches, per address. Rows are counted before they meet the override."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        keys = ["ip"] + (["website_id"] if "website_id" in rows.columns else [])
        out = rows.groupBy(*keys).agg(F.count("*").alias(name))
        return out if "website_id" in keys else out.withColumn("website_id", F.lit(""))
    both = counted(log, "logs").unionByName(counted(sessions, "sessions"), allowMissingColumns=True)
    sites = both.groupBy("ip", "website_id").agg(F.sum("logs").alias("logs"), F.sum("sessions").alias("sessions"))
    per_ip = sites.groupBy("ip").agg(F.sum("logs").alias("logs"), F.sum("sessions").alias("sessions"),
                                     F.count("*").alias("sites"))
    zero = F.lit(0).cast("long")
    return overrides.select("ip").join(per_ip, "ip", "left").select(
        "ip", *[F.coalesce(c, zero).alias(c) for c in ("logs", "sessions", "sites")])


def geo_override_upsert(overrides: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Entries replace overrides of the same address; entries without address or location are refused."""
    trimmed = entries.select(*[F.trim(c).alias(c) for c in ("ip", "domestic", "global", "note")])
    valid = trimmed.filter((F.col("ip") != "") & (F.col("domestic") != "") & (F.col("global") != ""))
    stamped = valid.withColumns({"created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long"),
                                 "_new": F.lit(1)})
    both = overrides.withColumn("_new", F.lit(0)).unionByName(stamped)
    values = ["domestic", "global", "note", "updated_at"]
    out = both.groupBy("ip").agg(F.max_by(F.struct(*values), "_new").alias("_v"), F.min("created_at").alias("created_at"))
    return out.select("ip", "_v.domestic", "_v.global", "_v.note", "created_at", "_v.updated_at")


def geo_override_delete(overrides: DataFrame, ips: DataFrame) -> DataFrame:
    return overrides.join(ips.select(F.trim("ip").alias("ip")).distinct(), "ip", "left_anti")


# ---- failures ---------------------------------------------------------------------------------------------------

def _selected(failures: DataFrame, log: DataFrame | None, reason: str, keyword: str) -> DataFrame:
    rows = failures
    if reason.strip():
        rows = rows.filter(F.col("reason") == reason.strip())
    if keyword.strip():
        rows = rows.filter(F.lower("ip").contains(keyword.strip().lower()))
    return rows if log is None else rows.join(log.select("ip").distinct(), "ip", "left_semi")


FAILURE_ORDER = [("created_at", True), ("id", True)]


def geo_failures(failures: DataFrame, log: DataFrame | None = None, reason: str = "", keyword: str = "",
                 number: int = 1, size: int = 50, after: Cursor | None = None) -> DataFrame:
    """A page of failures, newest first: the ``number``-th, or the one that follows the cursor ``after``. ``has_more`` says whether
    a next page exists; ``log`` restricts to a site's addresses."""
    size = size if size > 0 else 50
    number = max(number, 1)
    shown = page_and_more(_selected(failures, log, reason, keyword), FAILURE_ORDER, number, size, after)
    return shown.select("id", "ip", "source", "reason", "error", "status_code", "created_at", "has_more")


def geo_failures_clear(failures: DataFrame, log: DataFrame | None = None, reason: str = "",
                       keyword: str = "") -> DataFrame:
    """What is left after deleting the selection."""
    return failures.join(_selected(failures, log, reason, keyword).select("id"), "id", "left_anti")


# ---- map --------------------------------------------------------------------------------------------------------

def geo_map_rows(ranked: DataFrame, china: bool = True, names: DataFrame | None = None) -> DataFrame:
    """Rows of a location ranking as a map shows them: names unified, waiting and unknown places left out.

    ``names`` (name, label) renames countries on the world map.
    """
    rows = ranked.select(F.trim("key").alias("name"), F.col("uv").alias("value"), F.col("uv_percent").alias("percentage"))
    if china:
        rows = rows.withColumn("name", province_label("name"))
    elif names is not None:
        rows = rows.join(names, "name", "left").withColumn("name", F.coalesce("label", "name")).drop("label")
    return rows.filter(~is_hidden("name"))
