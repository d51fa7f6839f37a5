"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom.session import build_session, release  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINES = [
    "clean_text_documents",
    "clean_text_pages",
    "html_unescape_full",
    "dedup_keep_first",
    "clean_rows_documents",
    "drop_stages_report",
    "text_length_summary",
    "majority_vote_label",
    "label_left_join",
    "binarize_category",
    "weak_label",
    "threshold_sweep",
    "budget_sample_10",
    "random_split",
    "split_stratified",
    "cold_balanced_weak",
    "tfidf_fit",
    "tfidf_transform",
    "tfidf_vectors",
    "encode_fixed_length",
    "query_random",
    "query_least_confidence",
    "query_kmeans",
    "query_coreset",
    "svm_predict",
    "al_run_embeddings",
    "param_grid",
    "pending_experiments",
    "experiment_status",
    "experiment_summary",
    "metrics_long",
    "samples_round_trip",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the session outside the timings
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
