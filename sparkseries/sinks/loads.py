"""Loads into a stored table: each load once, its files clustered, listed and counted.

Below a table's path, each load has a folder of its own in

* ``rows``: Parquet files by time chunk, cut by range of device and time;
* ``files``: a row for each file with the devices and times it spans;
* ``counts``: rows and points of each device and time chunk;
* ``ledger``: one row, written last. A load that is not in the ledger is not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions.paths import decoded_path
from ..storage import new_path
from .tables import COMPRESSION, TIME_CHUNK_MS, with_time_chunk

ROWS_PER_FILE = 1_000_000
# Rows that a task sorts and cuts into files, if a file does not take more.
TASK_ROWS = 200_000
LEDGER = "load string, chunk bigint, time string, tag string, rows bigint, files bigint"
LOAD_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def load_table(
    df: DataFrame,
    path: str,
    load: str,
    mode: str = "append",
    rows_per_file: int = ROWS_PER_FILE,
    chunk: int = TIME_CHUNK_MS,
    fields: list[str] | None = None,
    time: str = TIME,
    tag: str = TAG,
) -> bool:
    """Store ``df`` as the load of that name; false if the table has it, and nothing is done.

    The input is computed once, into a staged copy. The copy is dealt by range of chunk, device and
    time to tasks, and each cuts its range into files of ``rows_per_file`` rows at most, so a device of a chunk lies in as many
    files as its rows need and at most two that it shares, and a device with very many rows is
    split by time. ``counts`` hold the present points of ``fields`` (all others by default).
    ``overwrite`` makes the load the only one of the table. A load that failed is done again as a
    whole. Rows with a null time or device are kept like others.
    """
    if not LOAD_NAME.fullmatch(load):
        raise ValueError(f"load names are made of letters, digits and _.-: {load!r}")
    spark = df.sparkSession
    if mode == "append" and load in {r.load for r in ledger(spark, path).collect()}:
        return False
    fields = fields if fields is not None else [c for c in df.columns if c not in (time, tag)]

    staged_at = new_path(spark, "staged")
    with_time_chunk(df, chunk, time).withColumn("__row", F.monotonically_increasing_id()).write.parquet(staged_at)
    staged = spark.read.parquet(staged_at)
    # Spark samples rows for each range on the driver: as many ranges as tasks need, not as files.
    number = max(1, -(-staged.count() // max(rows_per_file, TASK_ROWS)))
    order = ["time_chunk", tag, time, "__row"]
    rows_at = f"{path}/rows/load={load}"
    (
        staged.repartitionByRange(number, *order).sortWithinPartitions(*order).drop("__row")
        .write.mode("overwrite").partitionBy("time_chunk").option("compression", COMPRESSION)
        .option("maxRecordsPerFile", rows_per_file).parquet(rows_at)
    )
    rows = spark.read.schema(staged.drop("__row").schema).parquet(rows_at)
    rows.groupBy(decoded_path(F.col("_metadata.file_path")).alias("file"), "time_chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.min(tag).alias("first_tag"), F.max(tag).alias("last_tag"),
        F.count(tag).alias("tagged"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
    ).write.mode("overwrite").parquet(f"{path}/files/load={load}")
    rows.groupBy(tag, "time_chunk").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(f"`{f}`").alias(f"points_{f}") for f in fields]
    ).write.mode("overwrite").parquet(f"{path}/counts/load={load}")
    done = spark.read.parquet(f"{path}/files/load={load}").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files")
    ).select(
        F.lit(load).alias("load"), F.lit(chunk).cast("bigint").alias("chunk"), F.lit(time).alias("time"),
        F.lit(tag).alias("tag"), "rows", "files",
    ).coalesce(1)
    # The last step: from here on the load is part of the table.
    done.write.mode(mode).parquet(f"{path}/ledger")
    return True


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row for each load of the table: its name, chunk width, rows and files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def _loaded(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a part of the table that belong to loads in the ledger."""
    part = spark.read.parquet(f"{path}/{name}").withColumn("load", F.col("load").cast("string"))
    return part.join(F.broadcast(ledger(spark, path).select("load")), "load", "left_semi")


def _shape(spark: SparkSession, path: str):
    first = ledger(spark, path).select("chunk", "time", "tag").distinct().collect()
    if len(first) != 1:
        raise ValueError(f"{path} holds no load, or loads of different widths: {first}")
    return first[0]


def loaded_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, with ``load`` and ``time_chunk``."""
    rows = _loaded(spark, path, "rows")
    return rows.withColumn("time_chunk", F.col("time_chunk").cast("bigint"))


def scan_loads(
    spark: SparkSession, path: str, fields: list[str], device=None, start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Time, device and the named fields of a device (or all) in a closed time range.

    The list of files says which of them can hold such rows; no other file is opened. Paths of the
    files found come to the driver, as those of any scan do.
    """
    shape = _shape(spark, path)
    time, tag = shape["time"], shape["tag"]
    files = _loaded(spark, path, "files")
    wanted: list[Column] = []
    if device is not None:
        wanted.append(F.col(tag) == F.lit(device))
        files = files.where((F.col("first_tag") <= F.lit(device)) & (F.col("last_tag") >= F.lit(device)))
    if start is not None:
        wanted.append(F.col(time) >= F.lit(start))
        files = files.where(F.col("last_time") >= F.lit(start))
    if end is not None:
        wanted.append(F.col(time) <= F.lit(end))
        files = files.where(F.col("first_time") <= F.lit(end))
    like = spark.read.parquet(f"{path}/rows").select(time, tag, *fields)
    paths = [r.file for r in files.select("file").collect()]
    if not paths:
        return like.limit(0)
    rows = spark.read.schema(like.schema).parquet(*paths)
    for condition in wanted:
        rows = rows.where(condition)
    return rows


def count_loads(
    spark: SparkSession, path: str, field: str, first=None, last=None, start: int | None = None,
    end: int | None = None, by_device: bool = False,
) -> DataFrame:
    """Present points of the devices from ``first`` to ``last`` in a closed time range.

    Chunks that lie in the range as a whole come from the stored counts; only rows of the
    chunks at its two ends are read. A missing bound is open. One row, or one for each device that
    has rows there.
    """
    shape = _shape(spark, path)
    time, tag, width = shape["time"], shape["tag"], shape["chunk"]
    chunk = F.col("time_chunk").cast("bigint")

    def of_devices(rows: DataFrame) -> DataFrame:
        if first is not None:
            rows = rows.where(F.col(tag) >= F.lit(first))
        if last is not None:
            rows = rows.where(F.col(tag) <= F.lit(last))
        return rows

    counts = of_devices(_loaded(spark, path, "counts"))
    edges = set()
    if start is not None:
        counts = counts.where(chunk >= F.lit(start))
        if start % width:
            edges.add(start - start % width)
    if end is not None:
        counts = counts.where(chunk <= F.lit(end - width + 1))
        if (end + 1) % width:
            edges.add(end - end % width)
    parts = [counts.select(tag, F.col("rows").alias("n"), F.col(f"`points_{field}`").alias("points"))]
    if edges:
        rows = of_devices(_loaded(spark, path, "rows").where(chunk.isin(sorted(edges))))
        if start is not None:
            rows = rows.where(F.col(time) >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col(time) <= F.lit(end))
        present = F.col(f"`{field}`").isNotNull().cast("bigint")
        parts.append(rows.select(tag, F.lit(1).cast("bigint").alias("n"), present.alias("points")))
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    total = F.coalesce(F.sum("points"), F.lit(0)).alias("points")
    if not by_device:
        return both.agg(total)
    return both.groupBy(tag).agg(F.sum("n").alias("n"), total).where("n > 0").drop("n")
