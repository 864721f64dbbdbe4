"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte limits of a store with bounded columns; Parquet needs none, so nothing is cut unless asked for.
LIMITS = {
    "url": 2000, "referer": 2000, "browser": 256, "os": 256, "device": 256,
    "host": 255, "request_id": 256, "upstream_addr": 512,
}
UNLIMITED = ["ip", "method", "domestic", "global"]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def optional_field(raw: Column | str) -> Column:
    text = F.trim(_col(raw))
    return F.when(text == "-", "").otherwise(text)


def parse_int(raw: Column | str) -> Column:
    """Digits to a number; blank, ``-``, text and negatives give 0."""
    text = F.trim(_col(raw))
    return F.greatest(F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")), F.lit(0)), F.lit(0))


def decode_url(raw: Column | str) -> Column:
    """Percent-decoding with ``+`` as space; text with a broken escape stays as it is."""
    raw = _col(raw)
    return F.when(raw.contains("%") | raw.contains("+"), F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)


def append_query(url: Column | str, query: Column | str) -> Column:
    url, query = _col(url), _col(query)
    usable = (url != "") & (query != "") & (query != "-") & ~url.contains("?")
    tail = F.when(query.startswith("?"), query).otherwise(F.concat(F.lit("?"), query))
    return F.when(usable, F.concat(url, tail)).otherwise(url)


def request_parts(line: Column | str) -> Column:
    """Blank-separated words of a request line."""
    return F.split(F.trim(F.regexp_replace(_col(line), r"\s+", " ")), " ")


def clean_utf8(text: Column | str) -> Column:
    """No NUL characters; each run of invalid bytes becomes one ``?``."""
    # A well-formed U+FFFD in the input is also a replacement sign by then, hence the check on the bytes first.
    text = F.replace(_col(text), F.lit("\0"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.regexp_replace(F.make_valid_utf8(text), "�+", "?"))


def cut_bytes(text: Column | str, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    text = _col(text)
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit)
    whole = F.rtrim(F.make_valid_utf8(raw.cast("string")), F.lit("�"))
    return F.when(F.octet_length(text) > limit, whole).otherwise(text)


def sanitize_columns(columns: list[str], limits: dict[str, int] | None = None) -> dict[str, Column]:
    """Cleaning for every text column of a record; columns named in ``limits`` are cut to that many bytes."""
    limits = limits or {}
    return {name: cut_bytes(clean_utf8(name), limits[name]) if name in limits else clean_utf8(name)
            for name in columns if name in LIMITS or name in UNLIMITED}
