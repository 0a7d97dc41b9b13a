"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully computed through the ``noop`` sink (nothing is collected
to the driver, nothing is skipped), ``BENCH_RUNS`` times (default 2); the
reported time is the fastest run (JIT and code generation warm), the first
(cold) run is reported separately.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "redact_documents",     # outbound scan + redaction (flagship)
    "outbound_scan",
    "inbound_scan",
    "event_assembly",       # validate -> limit -> inbound -> outbound -> audit row
    "full_check",
    "policy_match",
    "gazetteer_spans",
    "overview_kpis",
    "requests_hourly",
    "top_users",
    "incident_list",
    "daily_statistics",
    "threat_summary",
    "user_activity",
    "rate_limit",
    "events_by_user_topk",
    "roc_auc",
    "stream_audit",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from vigilspark.session import get_session
    from vigilspark.plans.registry import queries

    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # warm-up: JVM, codegen caches, file listing
    qs["overview_kpis"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, cold = {}, {}
    for n in names:
        runs = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[n] = runs[0]
        times[n] = min(runs)
    from vigilspark.sources.tables import read_table
    n_docs = read_table(spark, sf_dir, "documents").count()
    out = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "rows_per_sec": {"redact_documents": round(n_docs / times["redact_documents"], 1)}
        if "redact_documents" in times else {},
        "runs_per_query": RUNS,
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
