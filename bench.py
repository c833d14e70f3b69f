"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8). Every query is
planned and run in full into a sink that drops the rows; the best of ``BENCH_RUNS`` runs counts (default 2).
"""

from __future__ import annotations

import json
import os
import sys
import time

from sparkmart.queries import QUERIES
from sparkmart.session import local_session

HEADLINE = (
    "mart_five_tables",
    "mart_customer_orders",
    "mart_composite_join",
    "mart_published",
    "value_map_status",
    "json_flatten_props",
    "bit_normalise",
    "temporal_text",
    "name_similarity",
    "cdc_decode",
    "cdc_route",
    "cdc_fold_last_present",
    "cdc_apply_to_mart",
    "cdc_fanout_update_many",
    "cdc_null_keys",
    "cdc_two_tables",
    "cdc_stream_mart",
    "versioned_current_view",
    "dedup_keep_first",
    "drift_report",
    "mismatch_groups",
    "column_facts",
    "source_tree",
    "runlog_current",
)


def main(names) -> dict:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    return {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "stream_events_per_sec": round(events / times["cdc_stream_mart"]) if "cdc_stream_mart" in times else None,
    }


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1:] or HEADLINE)))
