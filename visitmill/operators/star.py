"""Optional star schema: five dimensions beside the facts.

Keys are hashes of the values, so facts are encoded by a projection; no join, no key allocation, and the same key on
every run. The flat Parquet table needs none of this: its dictionary pages already store each value once per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.operators.shared import lookup

DIMENSIONS = {
    "ip": ["ip"],
    "url": ["url"],
    "referer": ["referer"],
    "ua": ["browser", "os", "device"],
    "location": ["domestic", "global"],
}

# Defaults of columns that older tables lack.
TRACE_COLUMNS = {
    "request_length": 0, "request_time_ms": 0, "upstream_response_time_ms": 0,
    "upstream_addr": "", "host": "", "request_id": "",
}


def key_of(columns: list[str]) -> Column:
    """128-bit hash: collisions stay out of reach for any number of urls."""
    return F.md5(F.concat_ws("\x1f", *columns))


def build_dims(log: DataFrame) -> dict[str, DataFrame]:
    return {name: log.select(key_of(cols).alias(f"{name}_id"), *cols).distinct() for name, cols in DIMENSIONS.items()}


def new_dim_rows(log: DataFrame, name: str, existing: DataFrame) -> DataFrame:
    """Rows to append to a dimension."""
    return build_dims(log)[name].join(existing, f"{name}_id", "left_anti")


def encode_facts(log: DataFrame) -> DataFrame:
    replaced = {c for cols in DIMENSIONS.values() for c in cols}
    keys = [key_of(cols).alias(f"{name}_id") for name, cols in DIMENSIONS.items()]
    return log.select(*[c for c in log.columns if c not in replaced], *keys)


def denormalize(facts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Facts with their values again; rows without a dimension row are dropped, as in any inner join."""
    out = facts
    for name in DIMENSIONS:
        out = lookup(out, dims[name], f"{name}_id", "inner", count_over=facts).drop(f"{name}_id")
    return out


def orphan_dims(facts: DataFrame, dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Dimension rows that facts still refer to."""
    return {name: dim.join(facts.select(f"{name}_id").distinct(), f"{name}_id", "left_semi")
            for name, dim in dims.items()}


def missing_columns(old: DataFrame) -> DataFrame:
    """Older tables brought to the current layout: absent numbers are 0, absent texts blank."""
    absent = {n: F.lit(v).cast("long") if v == 0 else F.lit(v)
              for n, v in TRACE_COLUMNS.items() if n not in old.columns}
    return old.withColumns(absent) if absent else old
