"""Headline queries on the test data; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query runs once to
warm up and then BENCH_RUNS times (default 1); the median is reported. Results are written to Spark's no-op sink, so
every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from visitmill.plans import catalog
from visitmill.session import local_session

HEADLINE = [
    "agg_hourly", "agg_daily_ip", "first_seen", "sessionize", "session_summary", "session_list", "merge_sessions",
    "timeseries_hourly", "overall", "compare_snapshots", "url_stats", "referer_stats", "location_city",
    "referer_ip_batch", "logs", "logs_distinct_ip", "logs_new_visitor", "realtime_series", "parse_nginx", "parse_ingress",
    "parse_caddy", "classify_ua", "whitelist_first_match", "geo_lookup", "geo_backfill", "encode_facts",
    "retention_cleanup_hourly", "kpi_day", "top_with_previous", "notification_rollup", "export_logs",
]


def run(query, spark, sf_dir) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus=cpus, memory="16g", shuffle=cpus)
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        run(queries[name], spark, sf_dir)
        seconds[name] = round(statistics.median(run(queries[name], spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
