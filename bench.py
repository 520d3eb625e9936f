"""Times the named queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 1); its time is the median.
The result is written to the noop sink, so every column is computed and none is collected.
$BENCH_QUERIES selects queries by name (comma separated) or "all"; the default is the headline
set, which touches every pipeline.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tillscope.plans.registry import QUERIES
from tillscope.session import local_session

HEADLINE = (
    "growth_accounting_monthly growth_accounting_trailing28 cohort_churn_milestones "
    "training_population gap_churn_run_rate grant_vs_usage segment_label seasonality_tag "
    "persona_final trialist_profile trialist_contacts churned_with_risk_history "
    "click_payment_match lookback_event_counts cumulative_customers reconcile_sources "
    "exposure_referral_rates top_fraction_share trailing_91d_mix adoption_windows "
    "event_table_schema cases_by_pair moment_all monthly_product_volume"
).split()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, "bench")
    times = {}
    for name in names:
        samples = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 3)
    print(json.dumps({
        "metric": "total seconds, sum of query medians", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
