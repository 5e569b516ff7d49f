"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8). Each
query is run to the end into a sink that discards its rows; nothing is kept between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sqltally.session import local_session  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINE = [
    "extract_sql",
    "identifier_set",
    "schema_f1",
    "difficulty",
    "completion_text",
    "read_split_others",
    "read_schema_text",
    "prompt_messages",
    "fewshot_prompt",
    "filter_report",
    "cache_gold_result",
    "result_match",
    "run_candidates",
    "execution_accuracy",
    "reward_phase2",
    "group_advantage",
    "failure_counts",
    "ex_by_difficulty",
    "method_delta",
    "running_ex",
    "mixed_batches",
    "reward_by_step",
    "reward_saturation",
    "q_group",
    "q_exists",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
