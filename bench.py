"""Runs the headline queries and prints one JSON line with their wall times."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepost.plans.registered import QUERIES  # noqa: E402
from tidepost.session import local_session  # noqa: E402

HEADLINE = (
    "G1_dashboard",
    "T1_newest_jobs",
    "G8_job_detail",
    "M3_version_history",
    "F2_plain_name",
    "F3_html_to_text",
    "F7_fingerprint",
    "U1_all_adapters",
    "M2_job_upsert",
    "M5_removal_sweep_jobs",
    "J6_fuzzy_match",
    "J9_survivors_of_one_user",
    "J14_merged_links",
    "M14_import_classify",
    "S3_rolling_activity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    asked = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in asked:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
