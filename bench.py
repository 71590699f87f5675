"""Headline queries, timed one by one; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from careflow.bindings.queries import QUERIES
from careflow.session import written_tables

HEADLINE = (
    "movements",
    "running_census",
    "census_ledger",
    "census_ledger_history",
    "occupancy_report",
    "peak_census",
    "daily_demand",
    "integerize_demand",
    "area_distances",
    "facility_distances",
    "daily_beds",
    "staff_hours",
    "floor_beds_initial",
    "flow_edges",
    "assign_cheapest",
    "plan_census",
    "plan_detail",
    "assign_with_capacity",
    "check_plan",
    "plan_horizon",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times, written = {}, {}
    for name in HEADLINE:
        started, before = time.perf_counter(), written_tables()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        written[name] = written_tables() - before
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "written_tables": written,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
