"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from evidentia.plans import catalog  # noqa: E402

HEADLINE = [
    "s8_retrieval_index", "r1_bm25", "r3_dense_text", "r3_exact_dense", "r5_hybrid_search", "r6_full_retrieve", "r8_section_retrieval", "g2_lexical_statistics",
    "c1_flatten_lines", "c5_record_chunks", "c10_narrative_pieces", "c15_boilerplate", "c15_clean_segments", "f16_tokens",
    "f17_hashed_embedding", "v1_claim_split", "v10_gate", "w11_citation_order", "g9_confidence", "v14_report_assembly",
    "f30_route", "f31_roster", "p2_incident_listing", "g17_document_rollup", "x4_run_completion", "x5_replay", "s10_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("evidentia-bench")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed: starting the JVM and the Python workers, and building the index that all searches share. Building an
    # index is timed by itself, as s8_retrieval_index.
    for name in ("r3_exact_dense", "r9_scale_lookup"):
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
