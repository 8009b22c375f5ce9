"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line: medians after two warm-ups."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from docquarry.queries import CATALOGUE

HEADLINE = (
    "flagship_filter_sort_topk",
    "agg_group_2",
    "agg_global",
    "variant_path_gt",
    "cdc_classify",
    "snapshot_latest",
    "sort_multi_topk",
    "and_or_nor",
    "elem_match_filter",
    "project_nested_embed",
    "merge_patch_shallow",
    "index_status",
)
WARM, RUNS = 2, 5


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        query = CATALOGUE[name][0]
        times = []
        for _ in range(WARM + RUNS):
            began = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[WARM:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
