"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the number of local threads. Each query
runs to the end through the ``noop`` sink: once to warm up, then three times, and the
middle time counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.plans import PLANS  # noqa: E402
from gridloom.session import local_session  # noqa: E402

# Query -> the table whose rows it goes through, for rows per second.
HEADLINE = {
    "filter_model": "lineitem",
    "sort_model": "orders",
    "page": "lineitem",
    "page_deep": "lineitem",
    "typed_parse": "orders",
    "infer_types": "events",
    "accepted_rows": "documents",
    "csv_scan": "documents",
    "arrow_export": "lineitem",
    "compact_changes": "events",
    "overlay_updates": "orders",
    "apply_changes": "orders",
    "insert_rows": "orders",
    "update_rows": "orders",
    "upsert": "customer",
    "replay_changes": "events",
    "cascade_delete": "lineitem",
    "migrate_shadow": "supplier",
    "migrate_shadow_merge": "lineitem",
    "retain_last_versions": "orders",
    "retain_last_snapshots": "lineitem",
    "integrity_report": "orders",
    "duplicate_keys": "lineitem",
    "fk_violations": "lineitem",
}
RUNS = 3


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session("gridloom-bench", cores)
    seconds, rates = {}, {}
    for name, source in HEADLINE.items():
        query = PLANS[name].run
        run(query, spark, sf_dir)
        seconds[name] = round(statistics.median(run(query, spark, sf_dir) for _ in range(RUNS)), 4)
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
        rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
