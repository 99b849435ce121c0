"""Times the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a
comma-separated choice. Every query runs once cold and once warm; the warm time
counts, both are reported. Results go to the no-op sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from vigilog.plans.queries import QUERIES
from vigilog.session import local_session
from vigilog.streaming import replay

HEADLINE = [
    "audit_distinct_principals",
    "audit_root_usage",
    "audit_geo_lookup",
    "audit_geo_sql_functions",
    "audit_unnest_records",
    "access_parse",
    "access_distinct_ip",
    "net_tor_events",
    "notify_unwrap",
    "json_deep_values",
    "obs_profiler_expand",
    "profile_first_seen",
    "profile_state",
    "alerts_access_key",
    "alerts_arn",
    "alerts_principal",
    "alerts_source_ip",
    "alerts_city",
    "alerts_country",
    "alerts_tor",
    "alert_counts_running",
    "profile_status",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    cold, warm = {}, {}
    for name in chosen.split(",") if chosen else HEADLINE:
        cold[name] = run(QUERIES[name], spark, sf_dir)
        warm[name] = run(QUERIES[name], spark, sf_dir)
    result = {
        "metric": "total_warm_query_time",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if not chosen:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
        start = time.perf_counter()
        replay.replayed(spark, sf_dir)
        spent = time.perf_counter() - start
        result["replay_stream"] = {
            "sec": round(spent, 3),
            "events_per_sec": round(events / spent, 1),
        }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
