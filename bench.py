"""Times the headline queries on local[$BENCH_CPUS] and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "A0_flagship_growth_leaders", "K1_fact_upsert", "S4_consolidated_facts", "R4_one_value", "L11_total_debt", "R14_normalized_periods",
    "W1_trailing_year", "A1_exact_median", "G11_total_score", "V6_discounted_cash_flow", "X3_category", "D2_opportunity_map",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("quarterdeck-bench").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from quarterdeck.queries import REGISTERED

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before the clock
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
