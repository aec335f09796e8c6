"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from threadloom.plans import QUERIES

HEADLINE = "unit_count_by_role agg_metrics_percentile session_rollup facets_idf filter_exists_semi action_pairing phases_gap streaks sequence_within bm25_topk rrf_hybrid lineage_roots cost_rollup tool_pairing_quality".split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, first = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(6):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        first[name], took[name] = round(times[0], 3), round(sorted(times[1:])[2], 3)
    print(json.dumps({"metric": "median of five warm runs, summed over the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first": first, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
