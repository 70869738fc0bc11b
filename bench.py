"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

All queries are first run once as a warm-up; then per query the output rows
are counted and it runs $BENCH_RUNS times into Spark's no-op sink (full
execution, nothing collected); the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "compile_engagement", "engaged_descriptions", "missing_topic_stats", "key_overlap",
    "null_counts", "duplicate_rows", "top_comments", "hec_wide", "user_conversation_rank",
    "top_topic_per_user", "ctfidf_terms", "topic_info", "knn", "density_clusters",
    "density_hierarchy", "topic_model", "topic_model_kmeans",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from threadlens.catalog import QUERIES
    from threadlens.session import build_session, drop_scratch

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)),
                          app_name="threadlens-bench")
    times, rows = {}, {}
    for name in names:  # warm-up pass over every query (JIT, file metadata)
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        q = QUERIES[name]
        rows[name] = q(spark, sf_dir).count()
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)
        drop_scratch(spark)   # intermediate tables of this query's runs
        print(f"{name}: {times[name]}s rows={rows[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows_out": rows, "sf": sf,
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
