"""Runs the headline queries and prints one JSON line: seconds by query and in all."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from textloom import plans

HEADLINE = [
    "normalize_ws", "length_stats", "doc_windows", "window_stats", "regex_hits", "exact_dups", "ngram_rank", "chi2_terms", "stratified_split", "proportional_head",
    "doc_max_score", "auc_by_group", "roc_curve", "tpr_at_fpr", "cluster_bootstrap_rate", "bootstrap_auc_ci", "holm", "contract_metrics",
    "hashed_ngrams_xx", "kwta_codes", "bloom_score", "centroid_score", "inner_join", "spend_rollup", "stream_session",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "8m",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
