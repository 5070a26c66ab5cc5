"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from graphloom.plans import registry
from graphloom.session import get_session

HEADLINE = [
    "G01_passage_windows", "G03_mentions", "G06_edges", "A04_canonical_counts", "K01_vector_top_k", "R04_hybrid", "R05_aggregation_leg",
    "R06_traversal_leg", "R08_routed_search", "G10_relation_boost", "G13_filtered_view", "J12_review_candidates", "T01_rate_limiter", "K02_full_text_top_k",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # the JVM's start isn't a query's time
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
