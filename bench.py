"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_REPEAT the runs
per query (the median counts) and BENCH_ONLY a comma list of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from galley.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "prompts_per_session", "first_occurrence",
    "stale_work", "chain_tips", "collisions", "task_focus", "interrupted_sessions",
    "survey_report", "demand_axes", "trailing_count",
    "style_verdict", "cross_section_repeats", "signature_terms", "sensitive_scan",
    "carry_forward_sections", "running_fence", "html_elements",
    "missing_copy", "drift_verdict", "shared_passages", "line_changes", "three_way_drift",
    "extents", "page_rollup", "fill_cells",
    "verdict", "contract_check", "resolve_precedence",
    "map_objects", "dictionary_match", "head_and_rest", "similar_top_k", "preference_test",
    "stream_trailing_count", "stream_idle_items",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    names = list(QUERIES) if only == ["all"] else only or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in names:
        once(name)  # warm-up
        timings[name] = round(statistics.median(once(name) for _ in range(repeat)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
