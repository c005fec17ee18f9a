"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3) are read from the environment.  Each query runs once
to warm up; the figure is the median of the runs, with all rows computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlark.plans.registry import QUERIES  # noqa: E402
from ledgerlark.session import local_session  # noqa: E402

HEADLINE = (
    "dashboard_summary",
    "dashboard_daily",
    "dashboard_top_products",
    "dashboard_store_comparison",
    "dashboard_coverage",
    "top_store_category",
    "top_store",
    "top_product",
    "top_product_category",
    "compare_aov",
    "trend_revenue",
    "revenue_all",
    "valid_sales",
    "quarantine",
    "ingestion_summary",
    "batch_metric_requests",
    "batch_comparisons",
    "batch_trends",
    "batch_rankings",
    "question_plan",
    "tool_calls",
    "question_answers",
    "published_runs",
    "quoted_line_breaks",
    "ingest_outcomes",
    "ingest_daily",
)


def seconds(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ledgerlark-bench")
    timings = {}
    for name in HEADLINE:
        seconds(QUERIES[name], spark, folder)
        timings[name] = round(
            statistics.median(seconds(QUERIES[name], spark, folder) for _ in range(runs)), 3
        )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
