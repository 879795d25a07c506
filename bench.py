"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
The headline value is the whole topic run (clean, embed, cluster, label), measured last in a
warm session; session start is not counted.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from topicloom.queries.registry import all_queries
from topicloom.session import local_session

HEADLINE = "recluster"
REPEAT_SECONDS = 5.0
QUERIES = [
    "topic_distribution", "clean_text", "preprocess_stats", "tokenize", "chunk_documents", "topic_info", "attach_topics",
    "samples_per_topic", "balance_summary", "topic_centroids", "topic_similarity", "topics_over_time", "sentiment_by_topic",
    "split_by_sentiment", "ctfidf", "term_counts", "top_phrases", "human_labels", "embed", "vector_math", "knn_exact", "knn_ivf",
    "semantic_search", "text_search", "assign_nearest", "merge_small_topics", "membership", "outliers_ctfidf", "representatives",
    "kmeans_sizes", "ngram_counts", "knn_pruned", "subtopic_sizes", "mmr", "hierarchy", "density_cluster", "sentiment_first", "answer_batch", "recluster",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "topicloom-bench")
    queries = all_queries()
    names = sys.argv[1:] or QUERIES
    seconds: dict[str, float] = {}
    queries["topic_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, not counted
    for name in names:
        runs = []
        while len(runs) < 3 and sum(runs) < REPEAT_SECONDS:  # the median of three, unless one run is long
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    headline = seconds.get(HEADLINE, sum(seconds.values()))
    print(json.dumps({
        "metric": "topic_run_seconds", "value": headline, "unit": "sec", "queries": seconds,
        "total": round(sum(seconds.values()), 3), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
