"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores
(default 8), BENCH_RUNS the timed runs per query (default 3, the median counts).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from tracewell.plans.catalog import QUERIES
from tracewell.session import build_session

HEADLINE = (
    "verdicts", "runs_rollup", "list_runs_topn", "run_explorer", "step_metrics", "baseline_stats", "step_anomalies",
    "slowest_fastest", "agent_summary", "cost_estimate", "metrics_long", "step_share", "tool_rules", "evidence_rules",
    "information_loss", "loss_verdicts", "ordered_evidence", "prompt_table", "handoff_diff", "normalized_steps",
    "trace_roundtrip", "extraction_parse", "structural_counts", "field_lists", "run_diff", "ground_truth",
    "label_confusion", "upsert_latest", "metrics_store", "stream_runs", "stream_tokens", "stream_flags",
)


def measure(spark, name: str, sf_dir: str, runs: int) -> float:
    """Median seconds to build and fully evaluate a query, after one warm-up."""
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench")
    found = {name: measure(spark, name, sf_dir, runs) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(found.values()), 3),
                "unit": "sec",
                "queries": found,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
