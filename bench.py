"""Benchmark the headline queries.

Runs each query on the tables at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS], forcing full execution with the no-op sink
(``write.format("noop")``): one warm-up run, then the median of
$BENCH_REPEAT runs (default 3) of the built plan; the driver-side plan
construction time is reported separately under "build_sec". Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "campaign_performance",
    "daily_ops_summary",
    "platform_scorecard",
    "pacing_analysis",
    "vast_error_rate",
    "quality_report",
    "quarantine_delivery",
    "ticket_payloads",
    "qa_results",
    "alert_messages",
    "sla_breach_report",
    "conversion_dedup",
    "dashboard_kpis",
    "load_summary",
]

# Queries that write silver tables while they are built: each timed run builds them anew.
WRITES_FIRST = {"alert_messages"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE

    from pacewise.plans.catalog import QUERIES
    from pacewise.session import drop_scratch, get_session

    spark = get_session(f"local[{cpus}]", app="pacewise-bench", shuffle_partitions=int(cpus))
    # The test tables are single-row-group files: spread them after the scan (see pacewise.sources.tables).
    spark.conf.set("pacewise.scan.partitions", cpus)
    # Session warm-up (JIT, class loading) at the benchmark scale, excluded from every timing.
    for warm in ("silver_delivery", "silver_campaigns", "silver_tickets"):
        for _ in range(2):
            QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    build: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)  # driver-side plan construction, timed separately
        build[name] = round(time.perf_counter() - t0, 3)
        df.write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeat):
            # Each run re-executes the whole plan from the Parquet files (nothing is cached).
            t0 = time.perf_counter()
            if name in WRITES_FIRST:
                df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    drop_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_query_seconds_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "build_sec": build,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "repeat": repeat,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
