"""Timestamps and durations in log text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time layouts of the built-in formats, written with the reference date of the layout language.
COMMON_LAYOUT = "02/Jan/2006:15:04:05 -0700"
HAPROXY_LAYOUT = "02/Jan/2006:15:04:05.000"
IIS_LAYOUT = "2006-01-02 15:04:05"

# Layout token -> datetime pattern.
LAYOUT_TOKENS = {
    "January": "MMMM", "Jan": "MMM", "2006": "yyyy", "-07:00": "xxx", "-0700": "xx", "Z07:00": "XXX",
    "Z0700": "XX", "01": "MM", "02": "dd", "15": "HH", "03": "hh", "04": "mm", "05": "ss", "06": "yy",
    "PM": "a", "_2": "d",
}
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def pattern_of(layout: str) -> str:
    """A datetime pattern for a layout; unknown letters or digits are refused."""
    names = "|".join(re.escape(t) for t in sorted(LAYOUT_TOKENS, key=len, reverse=True))
    out, rest = "", layout
    while rest:
        fraction = re.match(r"[.,](0+|9+)(?!\d)", rest)
        token = re.match(names, rest)
        if fraction:
            out += rest[0] + "S" * (len(fraction.group()) - 1)
            rest = rest[fraction.end():]
        elif token:
            out += LAYOUT_TOKENS[token.group()]
            rest = rest[token.end():]
        elif rest[0].isdigit():
            raise ValueError(f"unknown time layout: {layout}")
        else:
            word = re.match(r"[A-Za-z]", rest)
            text = rest[:1]
            if word and out.endswith("'"):
                out = out[:-1] + text + "'"
            else:
                out += f"'{text}'" if word else text
            rest = rest[1:]
    return out


def _with_layout(raw: Column, layout: str) -> Column:
    pattern = pattern_of(layout)
    if not re.search("[xXZ]", pattern):
        # A layout without zone means UTC, whatever the session zone is.
        raw, pattern = F.concat(raw, F.lit(" +0000")), pattern + " xx"
    return F.unix_seconds(F.try_to_timestamp(raw, F.lit(pattern)))


def epoch_number(value: Column) -> Column:
    """Whole epoch seconds of a number of seconds or (above 1e12) milliseconds."""
    return F.when(value > 1e12, value / 1000).otherwise(value).try_cast("long")


def parse_time(raw: Column | str, layout: str = "") -> Column:
    """Epoch seconds of an epoch text, the given layout, the common log layout, or ISO 8601; else NULL."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    digits = raw.rlike(r"^[0-9.]+$")
    layouts = [layout] if layout and layout != COMMON_LAYOUT else []
    texts = [_with_layout(raw, name) for name in [*layouts, COMMON_LAYOUT]]
    iso = F.when(raw.rlike(ISO), F.unix_seconds(F.replace(raw, F.lit(","), F.lit(".")).try_cast("timestamp")))
    return F.when(digits, epoch_number(raw.try_cast("double"))).otherwise(F.coalesce(*texts, iso))


# ---- durations --------------------------------------------------------------------------------------------------

# Unit -> nanoseconds.
UNITS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "μs": 1e3, "ms": 1e6, "s": 1e9, "m": 60e9, "h": 3600e9}
_UNIT = "|".join(UNITS)
_ONE = rf"(?i)(\d+(?:\.\d+)?)({_UNIT})"
_ALL = rf"(?i)^(?:\d+(?:\.\d+)?(?:{_UNIT}))+$"
_SOME = rf"(?i)\d+(?:\.\d+)?(?:{_UNIT})"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def scale_number(value: Column, milliseconds: bool) -> Column:
    """Seconds (or nanoseconds above 1e9) to whole milliseconds; negatives give 0."""
    if milliseconds:
        return F.greatest(value, F.lit(0.0)).try_cast("long")
    return (F.when(value > 1e9, value / 1e6).when(value < 0, F.lit(0.0)).otherwise(value * 1000)).try_cast("long")


def _one_duration(text: Column, milliseconds: bool) -> Column:
    def add(total: Column, piece: Column) -> Column:
        unit = F.lower(F.regexp_extract(piece, _ONE, 2))
        scale = F.lit(0.0)
        for name, nanos in UNITS.items():
            scale = F.when(unit == name, F.lit(nanos)).otherwise(scale)
        return total + (F.regexp_extract(piece, _ONE, 1).cast("double") * scale).cast("long")

    pieces = F.regexp_extract_all(text, F.lit(_ONE), F.lit(0))
    summed = F.aggregate(pieces, F.lit(0).cast("long"), add)
    return (F.when(text.rlike(_ALL), (summed / F.lit(1_000_000)).cast("long"))
            .when(~text.rlike(_SOME) & text.rlike(_NUMBER), scale_number(text.cast("double"), milliseconds)))


def parse_duration(raw: Column | str, milliseconds: bool = False) -> Column:
    """Whole milliseconds of ``0.245``, ``12ms``, ``1h2m3.5s`` or a comma list (its maximum); anything else is 0."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = F.trim(raw)
    parts = F.transform(F.split(text, ","), lambda part: _one_duration(F.trim(part), milliseconds))
    value = F.when(text.contains(","), F.array_max(parts)).otherwise(_one_duration(text, milliseconds))
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("long")
