"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is computed in full (noop sink) once, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenuria.plans import catalog  # noqa: E402
from tenuria.session import local_session  # noqa: E402

HEADLINES = (
    "scan_parquet",
    "dedup_first",
    "events_to_daily",
    "silver_customers",
    "silver_tickets",
    "engagement_windows",
    "customer_360",
    "customer_360_accounts",
    "snapshots_weekly",
    "snapshots_model",
    "features_cohort",
    "leak_report",
    "ts_folds",
    "ordinal_split",
    "auc_pr",
    "precision_at_k",
    "eval_by_cohort",
    "threshold_sweep",
    "evaluation_report",
    "intervention_plan",
    "global_importance",
    "cohort_heatmap",
    "engagement_box",
    "mon_psi",
    "mon_model_daily",
    "velocity_alert",
    "ab_assign",
    "train_gbt",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()

    def run(key: str) -> float:
        start = time.perf_counter()
        queries[key](spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("customer_360")
    times = {key: run(key) for key in (sys.argv[1:] or HEADLINES)}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(directory.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
