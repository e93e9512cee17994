"""Benchmark: headline queries on the driver tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the median run counts). Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query builds its marts from the raw driver tables (adapter included),
so a time covers the whole job from Parquet scan to result. Results are
small and collected; the row-level cleaning view and the export job write
to a no-op / scratch sink instead.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "sales_monthly_trend", "sales_by_category", "sales_by_state", "sales_payment_breakdown",
    "logistics_delivery_by_state", "logistics_delay_distribution", "logistics_freight_ratio",
    "logistics_route_performance", "reviews_score_distribution", "reviews_score_by_delay",
    "reviews_score_by_category", "reviews_score_by_payment", "clean_geolocation",
    "clean_orders", "home_kpis", "profile_duplicates", "export_manifest",
)
NOOP_SINK = {"clean_orders"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from souk.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, extra={
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    from souk.plans.queries import all_queries
    qs = all_queries()
    # Warm up the JVM (class loading, codegen caches) on a small query.
    qs["sales_payment_breakdown"](spark, sf_dir).collect()

    times: dict[str, float] = {}
    for key in HEADLINE:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            df = qs[key](spark, sf_dir)
            if key in NOOP_SINK:
                df.write.format("noop").mode("overwrite").save()
            else:
                df.collect()
            dt = time.perf_counter() - t0
            runs.append(dt)
        times[key] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
