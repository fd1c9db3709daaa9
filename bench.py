"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) select
data and cores; ``BENCH_QUERIES`` (comma-separated) and ``BENCH_RUNS`` narrow a run.
Each query is computed in full into a no-op sink; the value is the median run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "liberty_counts", "block_labels", "block_labels_small_tiles", "dead_blocks", "sweep_kept",
    "move_outcomes", "rect_join_counts", "rect_json", "replay_final", "replay_log",
    "settled_boards", "moves_parsed", "stones_checked", "idle_gaps", "rect_by_code_removed",
    "top_owners",
]


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        # The test tables are small: let a few hundred kB make a task of their own.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.openCostInBytes", "262144")
    )
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tessera-bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session(cpus)

    from tessera.plans import boards
    from tessera.plans.queries import QUERIES

    t = time.perf_counter()
    boards.stones(spark, sf_dir).count()
    boards.small_boards(spark, sf_dir).count()
    setup = time.perf_counter() - t

    def once(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup": round(setup, 3),
                "sf": float(sf_dir.rsplit("sf", 1)[-1]) if "sf" in sf_dir else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
