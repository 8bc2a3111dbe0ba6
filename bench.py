"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed, nothing
collected to the driver); the time of the best of ``BENCH_REPEAT`` runs is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "b1_dedup_events",
    "e2_journey_stats",
    "k7_snapshot_j1",
    "k7_snapshot_j2",
    "k9_prefix_snapshot_j2",
    "k12_score_timeline",
    "l3_static_features",
    "e22_gap_stats",
    "m2_pad_sequences_tpp",
    "n3_stratified_split",
    "q3_roc_auc",
    "q12_model_comparison",
    "t8_decompose",
    "u1_stream_journeys_batch_twin",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    os.environ.setdefault("JOURNEYFLOW_MASTER", f"local[{cpus}]")
    from journeyflow.plans.registry import all_queries
    from journeyflow.session import get_session

    spark = get_session(f"local[{cpus}]", partitions=int(cpus) * 2, app="journeyflow-bench")
    q = all_queries()
    # warm-up (JVM code paths, parquet footers)
    q["e1_log_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
