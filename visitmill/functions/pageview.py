"""The page-view rule."""

from __future__ import annotations

import dataclasses
import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitmill.functions.net import clean_ip, ip_key, is_private_ip

# Status codes and url patterns of the default rule.
STATUS_INCLUDE = [200]
EXCLUDE_PATTERNS = [
    r"favicon.ico$",
    r"robots.txt$",
    r"sitemap.xml$",
    r"\.(?:js|css|jpg|jpeg|png|gif|svg|webp|woff|woff2|ttf|eot|ico)$",
    r"^/api/",
    r"^/ajax/",
    r"^/health$",
    r"^/_(?:nuxt|next)/",
    r"rss.xml$",
    r"feed.xml$",
    r"atom.xml$",
]


@dataclasses.dataclass
class PageviewRules:
    """``exclude_ips`` given but empty also switches the private-address rule off."""

    status_include: list[int] = dataclasses.field(default_factory=lambda: list(STATUS_INCLUDE))
    exclude_patterns: list[str] = dataclasses.field(default_factory=lambda: list(EXCLUDE_PATTERNS))
    exclude_ips: list[str] | None = None

    @property
    def exclude_private(self) -> bool:
        return self.exclude_ips is None or len(self.exclude_ips) > 0


def text_key(ip: str) -> str | None:
    """The sort key of an address given on the driver."""
    try:
        parsed = ipaddress.ip_address(ip.strip())
    except ValueError:
        return None
    number = int(parsed) + (0xFFFF << 32 if parsed.version == 4 else 0)
    return f"{number:032x}"


def pageview_flag(status: Column | str, url: Column | str, ip: Column | str,
                  rules: PageviewRules | None = None) -> Column:
    """1 when the status counts, the address is not excluded and no pattern excludes the url."""
    rules = rules or PageviewRules()
    status, url = (F.col(c) if isinstance(c, str) else c for c in (status, url))
    address = clean_ip(ip)
    counts = status.isin(*rules.status_include)
    if rules.exclude_private:
        counts = counts & ~is_private_ip(address)
    keys = {text_key(i): i for i in rules.exclude_ips or []}
    texts = [i.strip() for k, i in keys.items() if k is None and i.strip()]
    known = [k for k in keys if k]
    if known:
        counts = counts & ~F.coalesce(ip_key(address).isin(*known), F.lit(False))
    if texts:
        counts = counts & ~address.isin(*texts)
    if rules.exclude_patterns:
        counts = counts & ~url.rlike("|".join(f"(?:{p})" for p in rules.exclude_patterns))
    return F.when(counts, 1).otherwise(0)
