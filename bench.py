"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.plans import all_queries  # noqa: E402
from riskframe.session import build_session  # noqa: E402

HEADLINE = (
    "split_text_profile train_val_test random_folds stratified_folds normalize_text tokenize clean_text "
    "text_stats pos_counts text_features_all rewrite_tokens vocab_topk bow_counts tfidf text_to_ids "
    "describe_numeric value_counts impute_mean standardize metrics_binary roc_curve auroc roc_band "
    "embedding_pool document_vectors lda_topics predictions"
).split()


def run(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or os.cpu_count()
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        cpus,
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            # The small tables come in one file each, which would leave all cores but one idle.
            "riskframe.input.partitions": str(cpus),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warm-up: class loading and the first Parquet footers.
    run(queries["word_count"], spark, folder)
    run(queries["train_val_test"], spark, folder)
    times = {}
    for name in names:
        times[name] = round(run(queries[name], spark, folder), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
