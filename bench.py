"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_ALL=1`` takes every query.
Each query runs once to warm up; the better of two further runs over its full result counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from recordflow.plans import registry
from recordflow.runtime import local_session

HEADLINE = [
    "map_long", "map_long_flat", "map_wide_flat", "validate_rows", "records_json", "quarantine",
    "flatten_paths", "flatten_wide", "profile_wide", "profile_long", "schema_paths", "mapping_template",
    "validate_mapping", "parse_json_array", "normalize_recommendations", "transcript", "build_messages",
    "cost_breakdown", "upsert_extractions", "review_table", "score_fields", "edge_cases", "cluster_sample",
    "run_report", "iteration_delta", "pseudonymize", "html_to_text", "unify_labels", "parse_generation",
    "stream_long_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(registry.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(min(run(name), run(name)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }))


if __name__ == "__main__":
    main()
