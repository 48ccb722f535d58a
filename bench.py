"""Times the headline queries; prints one JSON line.  ``naive`` holds the straightforward plans' seconds."""

import json
import os
import time

from pyspark.sql import SparkSession

from brindle.plans.frame import disable_optimizations
from brindle.plans.queries import QUERIES

HEADLINE = ("ts_cumsum_lookback", "filtered_join_inner", "filtered_join_many_keys", "asof_backward", "asof_nearest_tolerance", "join_between_left", "combine_two_sources", "unpivot_measures", "pivot_sparse", "cache_by_period", "delta_round_trip", "group_by_agg", "window_ranks")


def seconds(spark, f, sf) -> float:
    start = time.perf_counter()
    f(spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times, naive = {}, {}
    for name in HEADLINE:
        seconds(spark, QUERIES[name], sf)  # compiles code
        times[name] = seconds(spark, QUERIES[name], sf)
        with disable_optimizations():
            naive[name] = seconds(spark, QUERIES[name], sf)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "naive": naive, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
