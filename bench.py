"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then ``$BENCH_RUNS`` times; its time is the median. Results
go to a sink that reads every row, so that no column is optimized away.
"""

import json
import os
import statistics
import time

from tablecheck.plans import catalog
from tablecheck.session import local_session

HEADLINE = [
    "suite_run", "suite_from_rules", "suite_sql_scalars", "chk_completeness_ratio", "chk_referential_integrity",
    "chk_duplicate_excess", "chk_duplicate_groups", "chk_cross_table", "chk_custom_udf", "contract_validate",
    "profile_table", "profile_many", "pii_content_scan", "suggest_all", "library_suggestions", "suggest_merge",
    "recent_values", "trend_direction", "anomaly_ewma", "anomaly_holt_winters", "anomaly_detect_all",
    "all_scores", "dash_totals", "dash_top_failures", "results_list", "results_bi", "results_page", "run_detail",
    "alert_digest", "summary_report",
]


def fused_against_single(spark, folder: str) -> dict[str, float]:
    """25 checks on lineitem in one aggregation, and as 25 jobs of their own; its profile with sketches."""
    from tablecheck.operators import profile, suite
    from tablecheck.operators.checks import Rule

    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    rules = [
        Rule(f"{agg} {c}", "between", [-1e18, 1e18], metric=f"{agg}({c})")
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey") for agg in ("min", "max", "avg", "stddev", "count")
    ]
    times = {"checks25_fused": [], "checks25_single": [], "profile_approx": []}
    for _ in range(2):
        start = time.time()
        suite.evaluate(lines, rules).collect()
        times["checks25_fused"].append(time.time() - start)
        start = time.time()
        for rule in rules:
            suite.evaluate(lines, [rule]).collect()
        times["checks25_single"].append(time.time() - start)
        start = time.time()
        profile.profile_table(lines, distinct="approx").collect()
        times["profile_approx"].append(time.time() - start)
    return {k: round(v[-1], 3) for k, v in times.items()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for key in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.time()
            catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[key] = round(statistics.median(taken[1:]), 3)
    extra = fused_against_single(spark, folder)
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times | extra, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": spark.sparkContext.defaultParallelism, "runs": runs,
    }))


if __name__ == "__main__":
    main()
