"""Label expressions: referer kinds, own domains, place names, device groups."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitmill.schema import DIRECT, INTERNAL, SEP

# Substrings of search-engine referers.
SEARCH_ENGINES = [
    "baidu.", "google.", "bing.", "sogou.", "360.", "so.com", "yahoo.", "duckduckgo.", "yandex.",
]

SOURCE_KINDS = ["all", "search", "direct", "external"]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_direct(referer: Column | str) -> Column:
    return _col(referer).isin("-", "")


def is_search(referer: Column | str) -> Column:
    names = "|".join(re.escape(name) for name in SEARCH_ENGINES)
    return F.lower(_col(referer)).rlike(names)


def of_source(kind: str, referer: Column | str = "referer") -> Column:
    """Rows of one source kind; any other name means all rows."""
    if kind == "search":
        return is_search(referer)
    if kind == "direct":
        return is_direct(referer)
    if kind == "external":
        return ~is_direct(referer) & ~is_search(referer)
    return F.lit(True)


def source_kinds(referer: Column | str = "referer") -> Column:
    """All kinds a row counts for, as an array."""
    own = F.when(is_direct(referer), F.lit("direct")).otherwise(F.lit(None))
    found = F.when(is_search(referer), F.lit("search")).otherwise(F.lit(None))
    rest = F.when(~is_direct(referer) & ~is_search(referer), F.lit("external")).otherwise(F.lit(None))
    return F.array_compact(F.array(F.lit("all"), own, found, rest))


def clean_domain(text: str) -> str:
    """``https://a.b/`` -> ``a.b``; keeps a port; blank stays blank."""
    text = text.strip()
    if "://" in text:
        host = urlsplit(text).netloc.rpartition("@")[2]
        if host:
            return host.removesuffix("/")
    return text.removeprefix("//").removesuffix("/")


def is_internal(referer: Column | str, domains: list[str]) -> Column:
    """The referer is a page of one of the site's own domains, with or without path or port."""
    own = [re.escape(d) for d in map(clean_domain, domains) if d]
    if not own:
        return F.lit(False)
    return _col(referer).rlike(rf"(?s)^http.*://(?:{'|'.join(own)})(?:[/:].*)?$")


def referer_label(referer: Column | str, domains: list[str]) -> Column:
    return (F.when(is_direct(referer), DIRECT).when(is_internal(referer, domains), INTERNAL)
            .otherwise(_col(referer)))


def before_dot(place: Column | str) -> Column:
    """Text before the first middle dot, or all of it."""
    place = _col(place)
    at = F.instr(place, SEP)
    return F.when(at > 0, F.substring(place, F.lit(1), at - 1)).otherwise(place)


def after_dot(place: Column | str) -> Column:
    place = _col(place)
    at = F.instr(place, SEP)
    return F.when(at > 0, F.substring(place, at + 1, F.length(place))).otherwise(place)


def device_group(label: Column | str) -> Column:
    """desktop, mobile (phones and tablets) or other, from a device label in either language."""
    text = F.lower(_col(label))
    return (F.when(text.rlike("桌面|desktop|pc"), "desktop")
            .when(text.rlike("手机|移动|平板|mobile|tablet"), "mobile")
            .otherwise("other"))
