"""Projected and filtered scans of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..operators.queries import between


def open_table(spark: SparkSession, path: str, file_format: str) -> DataFrame:
    """The table at ``path``; values of folder names stay texts, so that a device 007 keeps its name.

    Folders are listed by a few tasks for each core, not by one for each folder.
    """
    settings = {
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        table = spark.read.format(file_format).load(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    if "time_chunk" in table.columns:
        table = table.withColumn("time_chunk", F.col("time_chunk").cast("bigint"))
    return table


def _scan(table: DataFrame, fields, start, end, device, suffix, time, tag, chunk) -> DataFrame:
    rows = between(table, start, end, time)
    if "time_chunk" in table.columns:
        # A record is never older than the start of its chunk: folders outside are not opened.
        if end is not None:
            rows = rows.where(F.col("time_chunk") <= F.lit(end))
        if start is not None and chunk is not None:
            rows = rows.where(F.col("time_chunk") >= F.lit(start - start % chunk))
    if device is not None:
        rows = rows.where(F.col(tag) == F.lit(device))
    if suffix is not None:
        rows = rows.where(F.col(tag).cast("string").endswith(suffix))
    return rows.select(time, tag, *fields)


def scan_parquet(
    spark: SparkSession, path: str, fields: list[str], start: int | None = None,
    end: int | None = None, device=None, suffix: str | None = None, time: str = TIME,
    tag: str = TAG, chunk: int | None = None,
) -> DataFrame:
    """Time, device and the named fields of the rows in a closed time range.

    ``chunk`` is the chunk width the table was written with, if it has time chunks;
    with it, chunks before the range are skipped as well.
    """
    table = open_table(spark, path, "parquet")
    return _scan(table, fields, start, end, device, suffix, time, tag, chunk)


def scan_orc(
    spark: SparkSession, path: str, fields: list[str], start: int | None = None,
    end: int | None = None, device=None, suffix: str | None = None, time: str = TIME,
    tag: str = TAG, chunk: int | None = None,
) -> DataFrame:
    """As :func:`scan_parquet`, from ORC files."""
    table = open_table(spark, path, "orc")
    return _scan(table, fields, start, end, device, suffix, time, tag, chunk)
