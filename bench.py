"""Time the headline queries over whole tables and print one JSON line.

Each query runs once to warm up and then three times; the median counts. Results go to a sink that computes every
row and column and keeps none. BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cloakwork.plans import run  # noqa: E402
from cloakwork.plans.session import build_session  # noqa: E402

HEADLINE = (
    "scan",
    "redact_for_store",
    "scan_inbound",
    "usage_log_rows",
    "quota_decisions",
    "daily_usage",
    "org_kpis",
    "site_discovery",
    "label_counts",
    "latest_k_per_org",
    "conversation_list",
    "cosine_top_k",
    "chunk_documents",
    "upsert_latest",
    "patch_rows",
    "alert_fan_out",
    "redact_finished_streams",
)


def timed(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        timed(name, spark, sf_dir)
        took[name] = round(statistics.median(timed(name, spark, sf_dir) for _ in range(repeats)), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of warm runs",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
