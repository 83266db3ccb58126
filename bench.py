"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of median seconds over three runs after a warm-up."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rankloom.plans.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["rank_mcdm_topk", "rank_bm25", "rank_rrf_fusion", "rank_knn_cosine", "dedupe_fingerprint_best", "phrase_document_frequency", "phrase_topk_by_length", "inverted_index_candidates", "fuzzy_quality_score", "sentiment_vote", "domain_assign_margin", "eval_classification_report", "text_anonymise", "events_tumbling", "events_sessions"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):
            at = time.time()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - at)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
