"""Runs headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line. Each query is run to its last row
(a noop sink); the first run of the session, which compiles code and starts workers, is not counted."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The first builds and writes the index that the searches after it read.
HEADLINE = [
    "index_build",
    "bm25_topk",
    "bm25_candidates_min_match",
    "lexical_boosts",
    "title_search",
    "postings_build",
    "execute_plans",
    "evidence_group_topk",
    "select_findings",
    "unit_tree_parents",
    "enumeration_aggregates",
    "exact_duplicates",
    "corpus_build",
    "corpus_audit_rules",
    "vector_topk",
    "metadata_normalise",
    "events_session",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from quill.catalogue import QUERIES
    from quill.catalogue.base import index

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        if name == "index_build":
            index(spark, sf_dir)
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("exact_duplicates")
    took = {}
    for name in HEADLINE:
        took[name] = round(run(name), 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
