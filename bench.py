"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace import catalog
from millrace.session import local_session

HEADLINE = [
    "prepare_split", "dedup_keep_first", "label_conflict_filter", "value_counts_topk", "per_entity_median_distribution", "equal_width_histogram",
    "pivot_period_counts", "group_mode_lowest", "left_join_lookup", "full_outer_revision_diff", "coverage_gap_cross", "hamming_nearest",
    "rule_predicate_join", "condition_grid", "confusion_metrics", "ece_brier", "kappa_pairs", "fleiss_patterns", "text_coverage", "shard_ntile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, max(8, int(cores) if cores.isdigit() else 8), "bench")
    queries = catalog.queries()
    run = lambda name: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # starts the JVM and compiles
    took = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - begun, 4)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
