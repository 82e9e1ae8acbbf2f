"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default sf0.1), BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "reconcile_rent", "summary_stats", "verify", "validate", "charge_summary",
    "apply_code_proposals", "unit_gaps", "highlights", "verify_against_stated",
    "score_report", "column_inventory", "walk_row_layout", "walk_block_layout",
    "latest_progress")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from unitwise.registry import all_queries
    queries = all_queries()
    queries["status_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        # The first run warms code generation; the median covers the others.
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name} {times[name]} (first {taken[0]:.2f})", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
