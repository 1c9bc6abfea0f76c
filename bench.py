"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is measured by the median of three runs, or by one run where that takes
on about the reference's own store size.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q1_build_feed", "d1_dedup_exact", "d2_dedup_near", "c4_score_local", "k3_merge_store",
    "j11_duplicate_applications", "a4_company_stats", "a31_scan_metrics", "w5_prior_avg_yield",
    "w7_failure_backoff", "v4_knn", "s4_normalize_greenhouse", "c6_score_hybrid", "a16_predict_relevance",
    "o7_select_examples", "p7_normalize_postings",
]
HEAD_TO_HEAD = {"d2_dedup_near": 16.7, "q1_build_feed": 19.6}     # seconds of the reference at 16k postings
SIZE = "/root/testdata/sf0.01"                                    # 15,000 postings
LONG = 20.0


def main() -> None:
    from hirelode import catalog
    from hirelode.launch import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, seconds = catalog.queries(), {}

    def once(name: str, where: str) -> float:
        start = time.time()
        queries[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.time() - start

    def measured(name: str, where: str) -> float:
        runs = [once(name, where)]
        if runs[0] <= LONG:
            runs += [once(name, where) for _ in range(2)]
        return round(statistics.median(runs), 3)

    once("p2_clean_company", folder)                              # start the engine
    for name in HEADLINE:
        seconds[name] = measured(name, folder)
        print(name, seconds[name], file=sys.stderr, flush=True)
    duel = {n: {"seconds": measured(n, SIZE), "reference": r} for n, r in HEAD_TO_HEAD.items()} if os.path.isdir(SIZE) else {}
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "head_to_head": duel}))


if __name__ == "__main__":
    main()
