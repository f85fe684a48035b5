"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query is built, planned and fully
computed into the no-op sink; work done while building, such as fitting the text index, counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caselink.plans import catalog
from caselink.session import local_session

HEADLINE = [
    "prepare_cases",
    "recent_cases",
    "summary_metrics",
    "top_areas",
    "monthly_trend",
    "yoy_trend",
    "analytics_report",
    "search_case_ids",
    "idf",
    "tfidf_weights",
    "tfidf_roundtrip",
    "candidate_pool",
    "similar_cases",
    "similar_by_area",
    "pair_features",
    "evaluate_similarity",
    "training_pairs",
    "train_ensemble",
    "ranked_cases",
    "compare_models",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    spark.range(1).count()
    seconds = {}
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
            }
        )
    )


if __name__ == "__main__":
    main()
