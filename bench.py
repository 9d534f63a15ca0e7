"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local threads and
``BENCH_RUNS`` the timed runs after one warm-up. Results are computed in full and
discarded, or written to a fresh folder by the load queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark
from pyspark.sql import SparkSession

from sparkseries.operators import (
    align_long_query,
    align_query,
    count_query,
    downsample,
    raw_query,
)
from sparkseries.plans import QUERIES
from sparkseries.plans.registry import event_points, table
from sparkseries.plans.series import DAY, EVENT_TYPES, FEBRUARY, HOUR, JANUARY, MINUTE, SENSORS
from sparkseries.sinks import write_discard, write_table
from sparkseries.storage import new_path

# Registered queries that are timed as they are.
REGISTERED = [
    "raw_limit_large", "raw_per_device", "range_scan_count", "suffix_scan_count", "keep_last",
    "wide_to_long", "long_to_wide", "group_points", "sparse_rows", "line_protocol", "json_points",
    "infer_types", "extend_series", "load_report", "latency_report", "csv_series", "csv_points",
    "geolife", "noaa", "mlab_utilization", "scan_parquet", "scan_orc", "stream_ingest",
    "stream_downsample",
]


def grid(spark, sf_dir):
    """The measured grid: result rows, bucket widths and numbers of series."""
    events = table(spark, sf_dir, "events")
    lineitem = table(spark, sf_dir, "lineitem")
    runs = {}
    for n in (10, 1_000, 10_000, 100_000):
        runs[f"raw_{n}"] = lambda n=n: raw_query(events, "value", n, time="ts", tag=None)
    runs["raw_one_device"] = lambda: raw_query(
        events, "value", 1000, device=8, time="ts", tag="user_id")
    runs["count"] = lambda: count_query(events, "value", FEBRUARY, time="ts", tag=None)
    runs["count_per_device"] = lambda: count_query(
        events, "value", FEBRUARY, time="ts", tag="user_id")
    for name, width in (("1m", MINUTE), ("1h", HOUR), ("1d", DAY)):
        for fill in (False, True):
            runs[f"downsample_{name}{'_fill' if fill else ''}"] = lambda w=width, f=fill: (
                downsample(events, "value", JANUARY, FEBRUARY, w, time="ts", tag=None, fill=f))
    for n in (1, 5):
        runs[f"align_{n}"] = lambda n=n: align_long_query(
            events, EVENT_TYPES[:n], time="ts", tag="user_id", name="event_type")
    runs["align_wide"] = lambda: align_query(
        lineitem, SENSORS, time="l_shipdate", tag="l_suppkey")
    return runs


def loads(spark, sf_dir):
    def write(file_format, layout):
        write_table(event_points(spark, sf_dir), new_path(spark, "bench"), file_format, layout)

    return {
        "load_discard": lambda: write_discard(event_points(spark, sf_dir)),
        "load_parquet": lambda: write("parquet", "chunk"),
        "load_orc": lambda: write("orc", "chunk"),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    actions = {}
    for name, query in grid(spark, sf_dir).items():
        actions[name] = lambda q=query: write_discard(q())
    actions.update(loads(spark, sf_dir))
    for name in REGISTERED:
        actions[name] = lambda n=name: write_discard(QUERIES[n](spark, sf_dir))
    medians, every = {}, {}
    for name, action in actions.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            action()
            times.append(time.perf_counter() - start)
        every[name] = [round(t, 4) for t in times[1:]]
        medians[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({
        "metric": "total_median_query_time",
        "value": round(sum(medians.values()), 4),
        "unit": "sec",
        "queries": medians,
        "runs": every,
        "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
        "cpus": int(cpus),
        "spark": pyspark.__version__,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
