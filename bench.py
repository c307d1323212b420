"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4),
BENCH_QUERIES (comma-separated subset, default the headline list), BENCH_CHECKPOINT_DIR
(default a new temporary folder; local mode only),
GRAPHWEFT_DRIVER_MEMORY (default 4g).
Each query is executed in full through the ``noop`` sink (every row computed, nothing
collected); the time per query is wall-clock seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d4_interaction_matrix",
    "c2_d1_users_degree",
    "c10_e15_edge_activation",
    "d18_e14_snapshot_counts",
    "e1_recent_tweets",
    "d15_c15_recent_tweet_vector",
    "i4_d17_g3_g4_numeric_block",
    "h1_pagerank_10_rounds",
    "h4_connected_components",
    "h7_relational_mean",
    "h7_root_sum",
    "e5_time_bins",
    "h5_snowball_sample",
    "h6_closure_entities",
    "i7_snapshot_split",
    "e12_topk_nodes_per_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    os.environ.setdefault("GRAPHWEFT_DRIVER_MEMORY", "4g")

    from graphweft.plans import registry
    from graphweft.session import get_spark

    folder = os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="graphweft-bench-")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="graphweft-bench",
                      extra={"spark.checkpoint.dir": folder})
    queries = registry.all_queries()
    times = {}
    for name in names:
        t0 = time.time()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
