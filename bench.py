"""Seconds per headline query, median of three runs; one JSON line on stdout.

The median leaves the cold first run out.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from mapwright.plans import catalog
from mapwright.session import build_session

HEADLINE = [
    "flagship_landmarks", "a01_rating_stats", "a04_movie_review_summary", "a12_mean_pool", "a13_describe_dimensions",
    "a28_correlations", "c01_movie_map", "c05_three_domain_map", "c06_feel_map", "c07_prepared_reviews", "f01_entity_filters", "f12_name_resolution", "j02_movies_with_stats_and_tags", "j08_record_linkage",
    "j15_distance_join", "k03_m_nearest_per_domain", "k09_item_statistics", "k14_review_samples", "e03_trustworthiness",
    "e05_map_metrics", "e08_projection_fidelity", "e09_map_comparison", "p28_shard_hash", "s05_pruned_scan", "v01_tfidf", "v03_truncated_svd", "v09_anchor_similarity",
    "v14_density_clusters", "v15_fusion_weight_sweep", "w01_keep_first", "w02_percentile_size", "w03_size_per_domain",
    "w11_balanced_domains",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench")
    queries, seconds = catalog.queries(), {}
    for name in names:
        times = []
        for _ in range(rounds):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
