"""Address expressions. Everything is built-in string work, so it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitmill.functions.bind import let

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
V4_TAIL = rf"^(.*:){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
EIGHT_GROUPS = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$"
V4_HEAD = "00000000000000000000ffff"
PRIVATE_V4 = r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|224\.0\.0\.)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_ip(raw: Column | str) -> Column:
    """First entry of a list; ``[v6]:port`` and ``v4:port`` without brackets and port."""
    first = F.trim(F.split_part(F.trim(_col(raw)), F.lit(","), F.lit(1)))
    inside = F.regexp_extract(first, r"^\[([^\]]*)\]", 1)
    colons = F.length(first) - F.length(F.replace(first, F.lit(":"), F.lit("")))
    return (F.when(first.startswith("["), F.when(first.contains("]"), inside).otherwise(first))
            .when((colons == 1) & first.contains("."), F.split_part(first, F.lit(":"), F.lit(1)))
            .otherwise(first))


def clean_ip(raw: Column | str) -> Column:
    """The stricter form used by filters: first non-blank entry, brackets and port removed."""
    raw = _col(raw)
    listed = F.regexp_extract(raw, r"^[\s,]*([^,]*[^,\s])?", 1)
    text = F.trim(listed)
    inside = F.regexp_extract(text, r"^\[([^\]]+)\]", 1)
    bare = F.when(inside != "", inside).otherwise(text)
    colons = F.length(bare) - F.length(F.replace(bare, F.lit(":"), F.lit("")))
    cut = F.when((colons == 1) & ~bare.startswith(":"), F.split_part(bare, F.lit(":"), F.lit(1))).otherwise(bare)
    # A plain address has nothing to remove; the steps above repeat their inputs many times.
    return F.when(~raw.rlike(r"[\s,\[:]"), raw).otherwise(cut)


def is_v4(ip: Column | str) -> Column:
    return _col(ip).rlike(V4)


def _hex2(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number.cast("long"))), 2, "0")


def _v4_hex(ip: Column) -> Column:
    return F.concat(*[_hex2(F.split_part(ip, F.lit("."), F.lit(i))) for i in (1, 2, 3, 4)])


def _dotted_tail(text: Column) -> Column:
    """``::ffff:1.2.3.4`` -> ``::ffff:0102:0304``."""
    tail = [_hex2(F.regexp_extract(text, V4_TAIL, i)) for i in (2, 3, 4, 5)]
    joined = F.concat(F.regexp_extract(text, V4_TAIL, 1), tail[0], tail[1], F.lit(":"), tail[2], tail[3])
    return F.when(text.rlike(V4_TAIL), joined).otherwise(text)


def _fill(text: Column) -> Column:
    """``::`` written out as groups of zeros; NULL where it would stand for none."""
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    given = colons - F.when(text.startswith("::"), 1).otherwise(0) - F.when(text.endswith("::"), 1).otherwise(0)
    middle = F.concat(F.repeat(F.lit(":0"), F.greatest(F.lit(8) - given, F.lit(0)).cast("int")), F.lit(":"))
    filled = F.regexp_replace(F.replace(text, F.lit("::"), middle), r"^:|:$", "")
    return F.when(~text.contains("::"), text).when(given < 8, filled)


def _v6_key(ip: Column) -> Column:
    def groups(text: Column) -> Column:
        parts = [F.lpad(F.split_part(text, F.lit(":"), F.lit(i)), 4, "0") for i in range(1, 9)]
        return F.when(text.rlike(EIGHT_GROUPS), F.concat(*parts))

    return let(let(_dotted_tail(F.lower(ip)), _fill), groups)


def ip_key(ip: Column | str) -> Column:
    """32 hex digits that sort like the address (v4 as mapped v6); NULL for anything else."""
    ip = _col(ip)
    return F.when(is_v4(ip), F.concat(F.lit(V4_HEAD), _v4_hex(ip))).when(ip.contains(":"), _v6_key(ip))


def is_private_key(key: Column) -> Column:
    """The same rule on a key, for addresses already turned into one."""
    v4 = key.startswith(V4_HEAD)
    quad = F.substring(key, 25, 8)
    private_v4 = quad.rlike("^(0a|7f|c0a8|a9fe|ac1|e00000)")
    private_v6 = (key == "0" * 31 + "1") | key.rlike("^(fe[89ab]|f[cd]|ff.2)")
    return F.coalesce(F.when(v4, private_v4).otherwise(private_v6), F.lit(False))


def is_private_ip(ip: Column | str) -> Column:
    """Loopback, link-local, private v4 blocks and fc00::/7; text that is no address is not private."""
    def rule(text: Column) -> Column:
        # The head is looked at first, as it settles most addresses at their first digits.
        return F.when(text.rlike(PRIVATE_V4) & is_v4(text), True).when(
            text.contains(":"), let(ip_key(text), is_private_key)).otherwise(False)
    return let(_col(ip), rule)
