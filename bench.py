"""Headline queries, timed; prints one JSON line.

Each query runs BENCH_RUNS times and its best time counts: the first run of a plan also
compiles it, which says nothing about the work on the data.

BENCH_SF_DIR   folder of test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     runs per query (default 2)
BENCH_QUERIES  comma-separated names to run instead of the headline set
"""

from __future__ import annotations

import json
import os
import time

from boxrates.conformance.registry import QUERIES
from boxrates.session import local_session

HEADLINE = [
    "quote_merge_latest",
    "parity_spot_chain",
    "boxes_full",
    "boxes_scale",
    "boxes_by_supplier",
    "boxes_daily",
    "term_structure_scale",
    "rate_heatmap_scale",
    "top_opportunities_scale",
    "chain_quotes",
    "stream_quotes",
    "collect_snapshot",
    "snapshot_roundtrip",
    "stream_boxes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus))

    def run(name: str) -> float:
        start = time.perf_counter()
        # Every row and column is computed, and nothing is collected.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("quote_mid")  # starts the executor threads and warms the file reader
    seconds = {name: round(min(run(name) for _ in range(runs)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
