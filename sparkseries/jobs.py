"""Load and query jobs that measure themselves; ``python -m sparkseries`` runs them.

Counts come from observed metrics of the job itself, not from a second pass.
"""

from __future__ import annotations

import argparse
import json
import time as clock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import TAG, TIME
from .operators import align_query, count_query, downsample, jitter_time, raw_query
from .operators.layout import present_cells, sensor_columns
from .sinks import (
    json_points,
    line_protocol,
    metric_points,
    record_payload,
    write_discard,
    write_table,
    write_text,
)
from .sources import (
    CsvSeries,
    generate_wide,
    list_files,
    read_csv_series,
    read_geolife,
    read_mlab_ip,
    read_mlab_utilization,
    read_noaa,
    read_redd,
    read_synthetic,
    read_tdrive,
    read_type_catalog,
    scan_orc,
    scan_parquet,
)
from .sources.stored import open_table

PAYLOADS = {
    "line": line_protocol,
    "json": json_points,
    "json_single": lambda df: json_points(df, batched=False),
    "metric": metric_points,
    "records": record_payload,
}

# The times up to which the measured series holds about n points.
COUNT_UNTIL = {
    1: 1601023212859,
    100: 1601023262692,
    10_000: 1601045811969,
    100_000: 1601136597344,
    1_000_000: 1604742917425,
    10_000_000: 1640035162526,
    100_000_000: 1993728579671,
}
# The time range of the measured downsampling queries and scans.
DOWNSAMPLE_RANGE = (1601023212859, 1993732295961)
SCAN_RANGE = (0, 1946816515000)


def read(
    spark: SparkSession,
    source: str,
    path: str | None = None,
    begin: int = 0,
    end: int | None = None,
    csv: CsvSeries = CsvSeries(),
    catalog: DataFrame | None = None,
    **options,
) -> DataFrame:
    """A dataset by its kind; ``begin`` and ``end`` number the files in path order."""
    if source == "synthetic":
        return read_synthetic(spark, **options)
    some = begin > 0 or end is not None
    files = list_files(spark, path, begin, end) if some else None
    if source == "csv":
        return read_csv_series(spark, files or path, csv, catalog)
    if source in ("mlab_utilization", "mlab_ip"):
        reader = read_mlab_utilization if source == "mlab_utilization" else read_mlab_ip
        return reader(spark, files or path)
    readers = {
        "geolife": read_geolife, "noaa": read_noaa, "tdrive": read_tdrive, "redd": read_redd,
    }
    return readers[source](spark, path, files=files, **options)


def load(
    df: DataFrame,
    sink: str = "parquet",
    out: str | None = None,
    layout: str = "chunk",
    mode: str = "overwrite",
    std_dev: float = 0.0,
) -> dict:
    """Write a dataset and report records, points, time and points per second."""
    fields = sensor_columns(df)
    observed = Observation()
    rows = jitter_time(df, std_dev).observe(
        observed, F.count(F.lit(1)).alias("records"), F.sum(present_cells(fields)).alias("present")
    )
    start = clock.perf_counter()
    if sink == "discard":
        write_discard(rows)
    elif sink in PAYLOADS:
        write_text(PAYLOADS[sink](rows), out, mode)
    else:
        write_table(rows, out, sink, layout, mode)
    elapsed = clock.perf_counter() - start
    records = observed.get["records"] or 0
    return {
        "records": records,
        "points": records * len(fields),
        "present_points": observed.get["present"] or 0,
        "time_ms": round(elapsed * 1000, 3),
        "points_per_s": round(records * len(fields) / elapsed, 1),
    }


def query(
    df: DataFrame,
    kind: str,
    param: int,
    device: str | None = None,
    field: str | None = None,
    start: int | None = None,
    end: int | None = None,
    until: int | None = None,
    fill: bool = False,
) -> DataFrame:
    """One of the four query shapes by its parameter.

    ``raw``: the first ``param`` points. ``align``: ``sensor1 .. sensor<param>``.
    ``count``: points up to ``until``, or up to the time listed for ``param``.
    ``downsample``: points per ``param`` milliseconds.
    """
    if kind == "raw":
        return raw_query(df, field, param, device=device)
    if kind == "align":
        return align_query(df, [f"sensor{i}" for i in range(1, param + 1)], device=device)
    if kind == "count":
        return count_query(df, field, COUNT_UNTIL[param] if until is None else until, device)
    if kind == "downsample":
        first = DOWNSAMPLE_RANGE[0] if start is None else start
        last = DOWNSAMPLE_RANGE[1] if end is None else end
        return downsample(df, field, first, last, param, device=device, fill=fill)
    raise ValueError(f"unknown query {kind}")


def timed_query(result: DataFrame) -> dict:
    """Compute a result, keep none of it, and report its size and the time."""
    observed = Observation()
    columns = len(result.columns)
    rows = result.observe(observed, F.count(F.lit(1)).alias("lines"))
    start = clock.perf_counter()
    write_discard(rows)
    elapsed = clock.perf_counter() - start
    lines = observed.get["lines"] or 0
    return {
        "lines": lines, "points": lines * (columns - 1), "time_ms": round(elapsed * 1000, 3),
    }


def wide_scan(spark: SparkSession, out: str, sensors: int, rows: int = 1) -> dict:
    """Write records of many sensors, then count them by a scan of one sensor, in ms."""
    report = {}
    for file_format, scan in (("parquet", scan_parquet), ("orc", scan_orc)):
        path = f"{out}/{file_format}-{sensors}"
        start = clock.perf_counter()
        generate_wide(spark, rows, sensors).write.format(file_format).mode("overwrite").save(path)
        written = clock.perf_counter()
        by_name = {"device": "device"} if file_format == "parquet" else {"suffix": "device"}
        found = scan(spark, path, ["s1"], *SCAN_RANGE, **by_name)
        size = timed_query(found)
        report[file_format] = {
            "write_ms": round((written - start) * 1000, 3), "query_ms": size["time_ms"],
            "lines": size["lines"],
        }
    return report


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkseries")
    jobs = parser.add_subparsers(dest="job", required=True)
    loading = jobs.add_parser("load")
    loading.add_argument("--source", required=True)
    loading.add_argument("--path")
    loading.add_argument("--out")
    loading.add_argument("--sink", default="parquet")
    loading.add_argument("--layout", default="chunk")
    loading.add_argument("--mode", default="overwrite")
    loading.add_argument("--begin-file", type=int, default=0)
    loading.add_argument("--end-file", type=int)
    loading.add_argument("--sep", default=",")
    loading.add_argument("--infer-rows", type=int)
    loading.add_argument("--zone", default="UTC")
    loading.add_argument("--catalog")
    loading.add_argument("--std-dev", type=float, default=0.0)
    asking = jobs.add_parser("query")
    asking.add_argument("--table", required=True)
    asking.add_argument("--format", default="parquet")
    asking.add_argument("--kind", required=True)
    asking.add_argument("--param", type=int, required=True)
    asking.add_argument("--device")
    asking.add_argument("--field")
    asking.add_argument("--start", type=int)
    asking.add_argument("--end", type=int)
    asking.add_argument("--until", type=int)
    asking.add_argument("--fill", action="store_true")
    asking.add_argument("--name", default="query")
    asking.add_argument("--show", action="store_true")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.job == "load":
        csv = CsvSeries(sep=args.sep, infer_rows=args.infer_rows, zone=args.zone)
        catalog = read_type_catalog(spark, args.catalog) if args.catalog else None
        df = read(spark, args.source, args.path, args.begin_file, args.end_file, csv, catalog)
        report = load(df, args.sink, args.out, args.layout, args.mode, args.std_dev)
        print(json.dumps(report))
        return
    df = open_table(spark, args.table, args.format)
    result = query(
        df, args.kind, args.param, args.device, args.field, args.start, args.end, args.until,
        args.fill,
    )
    if args.show:
        result.show()
    report = timed_query(result)
    print(json.dumps({k: report[k] for k in ("lines", "points")}))
    # The form that latency_report reads.
    print(f'Exp:"{args.name}" done! Query Param:{args.param}. '
          f'query time: {report["time_ms"]} ms')
