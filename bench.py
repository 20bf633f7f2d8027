"""Times the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparkloom.plans.catalog import QUERIES

HEADLINE = [
    "bm25_topk",
    "tfidf_topk",
    "hybrid_rrf",
    "multi_query_rrf",
    "bm25_many_queries",
    "bm25_many_queries_top20",
    "term_stats",
    "dedup_first",
    "cutoff_filter",
    "chunks",
    "claim_elements",
    "evidence_validation",
    "weighted_charts",
    "upsert_latest",
    "claim_roots",
    "dense_cosine_topk",
    "delta_assembly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()  # the JVM is warm and files are cached
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
