"""Benchmark: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default: HEADLINE), BENCH_EVENT_LOG (folder
     for Spark's event log; off when unset).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "weekly_fact", "lfl_growth", "lfl_elasticity", "yoy_health", "weekly_yoy_detail", "trailing_growth",
    "recent_kpis", "channel_signals", "monthly_fact", "health_score", "project_baseline", "safe_budget",
    "month_ledger", "seasonal_backtest", "parse_iso_week", "clean_currency", "rf_forecast", "additive_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    extra = {"spark.ui.showConsoleProgress": "false"}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})

    from panelcast.plans.registry import QUERIES
    from panelcast.session import build_session

    spark = build_session(f"local[{cpus}]", app="panelcast-bench", shuffle_partitions=int(cpus), extra=extra)
    # JVM / codegen warm-up on a different folder-independent query shape
    spark.range(1000).selectExpr("sum(id)").collect()

    timings = {}
    t_all = time.time()
    for n in names:
        t = time.time()
        QUERIES[n](spark, sf_dir).collect()
        timings[n] = round(time.time() - t, 3)
    total = round(time.time() - t_all, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
