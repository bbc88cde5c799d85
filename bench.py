"""Time the registered queries; prints one JSON line.

    BENCH_SF_DIR   data folder              (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores              (default 8)
    BENCH_QUERIES  comma separated subset   (default: all)

The given tables are single files with one row group, which one task scans.  They
are first written once, untimed, with a part for every core, as a table of any size
would lie; the queries read that copy, all rows of it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from textlabels.plans import QUERIES
from textlabels.sources.workspace import new_path, release

TABLES = "events documents embeddings benchmark labels conversations".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("textlabels-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()     # warm-up

    source, sf_dir = sf_dir, new_path(spark, "bench-tables")
    for name in TABLES:
        if os.path.exists(f"{source}/{name}.parquet"):
            spark.read.parquet(f"{source}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{sf_dir}/{name}.parquet")

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(source.rstrip("/")).removeprefix("sf")}), flush=True)
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
