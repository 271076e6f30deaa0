"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Each query runs once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import time

from netsift.plans import catalog
from netsift.session import local_session

HEADLINE = [
    "triage_events", "triage_counts", "watchlist_match", "route_flows", "source_activity", "activity_top_ports",
    "recent_verdicts", "review_priority", "event_assembly", "daily_counts", "daily_summary", "report_events",
    "confusion", "slice_metrics", "fp_counts", "numeric_summary", "topology_nodes", "topology_edges", "zone_lookup",
    "seed_watchlist", "enrich_cve_hints", "lint_watchlist", "time_split", "stratified_split", "select_thresholds",
    "binary_metrics", "upsert_flows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.ui.showConsoleProgress": "false"})
    catalog.load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        run = catalog.QUERIES[name]
        for _ in range(2):
            started = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    flows = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "flows": flows,
        "triage_flows_per_sec": round(flows / times["triage_events"], 1), "cores": cores,
    }))


if __name__ == "__main__":
    main()
