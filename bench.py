"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed in full through the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "evaluate_metric",
    "kendall_per_source",
    "kendall_per_lp",
    "kendall_overall",
    "soft_pairwise_accuracy",
    "pair_agreement",
    "per_source_detail",
    "tau_distribution",
    "score_profile",
    "stats_grouping_sets",
    "gold_quintiles",
    "build_features",
    "weight_sweep",
    "preference_pairs",
    "pair_cap",
    "pair_loss",
    "spearman_props",
    "cv_ensemble",
    "ridge_stack",
    "isotonic_oof",
    "weight_lines",
    "weight_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("VETTA_MASTER", f"local[{cpus}]")
    from vetta.session import get_session
    from vetta.queries import REGISTRY

    spark = get_session(shuffle_partitions=int(cpus) * 2)
    only = [a for a in sys.argv[1:] if a in REGISTRY] or HEADLINE
    # warm the JVM and Python workers on a tiny query (not timed)
    REGISTRY["doc_structure"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
