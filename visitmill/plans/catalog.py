"""All registered queries."""

from __future__ import annotations

from visitmill.plans import flow_queries, geo_queries, parse_queries, stat_queries, table_queries
from visitmill.plans.registry import Query, Registry


def _all() -> Registry:
    everything = Registry()
    for part in (stat_queries, parse_queries, geo_queries, table_queries, flow_queries):
        everything.update(part.REG)
    return everything


def queries() -> dict[str, Query]:
    return _all().queries


def oracle_sql() -> dict[str, str]:
    return _all().sql
