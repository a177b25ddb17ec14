"""Times the headline queries on the given data and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f4_pooled_metrics", "f6_count_metrics", "f11_aggregate_benchmark", "f12_rank_models", "f16_condition_errors", "g1_average_rank",
    "d7_match_by_tokens", "d10_candidate_pairs", "e3_connected_components", "e5_pairwise_geometry_masks", "e13_match_objects", "e25_greedy_nms",
    "f1_score_units", "h4_benjamini_hochberg", "h9_contrast_effects", "h12_error_significance", "k3_file_audit", "l3_size_matched_control",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from gridtally.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["f4_pooled_metrics"](spark, sf_dir).collect()  # start the workers and load the classes
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
