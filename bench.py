"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Each query is run once to warm up and then three times into a sink that keeps nothing; its median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from lodestar.queries import DEFINED, VIEWS, engine

RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = engine(spark, folder)
    took: dict[str, float] = {}
    for name in [n for n in DEFINED if n.startswith("bench_")] + ["flagship"]:
        seconds = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            tables.sql(DEFINED[name][0]).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name.removeprefix("bench_")] = round(median(seconds[1:]), 4)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf"), "views": len(VIEWS)}))
    spark.stop()


if __name__ == "__main__":
    main()
