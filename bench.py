"""Seconds per headline query, warm, as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS
(default 3, the median counts) come from the environment.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from awardlens.registry import QUERIES  # noqa: E402

HEADLINE = [
    "funding_trends",
    "sector_funding_top5",
    "sector_funding_filtered",
    "award_types",
    "funding_rollup",
    "outlay_summary",
    "outlay_vs_potential",
    "obligated_vs_potential",
    "outlay_sample_exact",
    "value_quantiles",
    "edge_cases",
    "stratified_sample",
    "subset_union_distinct",
    "subset_own_columns",
    "subset_semi_join",
    "csv_roundtrip",
    "outlay_drops",
    "ingest_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("awardlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken = time.perf_counter() - start
        spark.catalog.clearCache()
        return taken

    timings = {}
    for name in HEADLINE:
        seconds(name)
        timings[name] = round(statistics.median(seconds(name) for _ in range(runs)), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
