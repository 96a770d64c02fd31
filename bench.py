"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times into the noop sink, which computes every
row without writing; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans.registry import queries  # noqa: E402
from faultline.plans.session import local_session  # noqa: E402

HEADLINE = [
    "failure_rate_a1c_day_zone_90d",
    "failure_rate_a1d_hour_zone_30d",
    "failure_rate_a1s_day_env_360d",
    "a2_failure_rate_by_env",
    "a3a_latency_zone_asia",
    "a3d_latency_by_concurrency",
    "a4a_error_types_asia_90d",
    "a4c_error_types_all",
    "a4d_errors_by_function_7d",
    "a4g_error_type_histogram",
    "a4h_error_counts_cross",
    "a5_errors_by_call_asia",
    "a6a_errors_by_hour_asia_7d",
    "a7_unpingable_ips_europe_90d",
    "a8b_tests_per_day_env",
    "a12_requests_per_env",
    "a13_request_rate",
    "wp1_percentile_rows",
    "wp1_percentile_rows_env",
    "wp3_sequential_failures",
    "wp5_failure_rate_moving_avg",
    "r1_rollup_test_results",
    "r2_milestone_times",
    "r4_retry_attempts",
    "r6_io_throughput",
    "x1_classify_error_log",
    "p2_series_by_env",
    "u1_orphaned_ips",
    "w3_upsert_pass_end",
    "w4_scrub_errors",
    "w5_assign_ids",
    "w6_cascade_delete_actions",
    "t1_stream_request_rate",
    "t2_stream_failure_rate",
    "t3_stream_sequential_failures",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    timings = {}
    for name in HEADLINE:
        samples = []
        for _ in range(4):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples[1:]), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
