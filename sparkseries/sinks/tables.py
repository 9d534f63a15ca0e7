"""Stored tables, clustered for reading by device and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions import bucket_start
from ..operators.layout import MAX_FIELDS, rejoin, vertical_split

# Seven days, the width of a time chunk, and the file compression.
TIME_CHUNK_MS = 604_800_000
COMPRESSION = "snappy"


def with_time_chunk(
    df: DataFrame, width: int = TIME_CHUNK_MS, time: str = TIME, name: str = "time_chunk"
) -> DataFrame:
    """Add the start of the time chunk a record belongs to, for use as a partition column."""
    return df.withColumn(name, bucket_start(F.col(time), width))


def write_table(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    layout: str = "chunk",
    mode: str = "overwrite",
    chunk: int = TIME_CHUNK_MS,
    time: str = TIME,
    tag: str = TAG,
) -> None:
    """Write Parquet or ORC files, sorted by device and time.

    ``device``: a folder per device, for few devices. ``chunk``: a folder per time chunk.
    ``single``: no folders. Rows are rebalanced by folder, or by device where there are none;
    adaptive execution splits what is too large for one task and joins what is too small.
    """
    if layout == "device":
        folders, clustered = [tag], df.hint("rebalance", tag)
    elif layout == "chunk":
        folders = ["time_chunk"]
        clustered = with_time_chunk(df, chunk, time).hint("rebalance", "time_chunk")
    elif layout == "single":
        folders, clustered = [], df.hint("rebalance", tag)
    else:
        raise ValueError(f"unknown layout {layout}")
    keys = list(dict.fromkeys([*folders, tag, time]))
    writer = clustered.sortWithinPartitions(*keys).write.mode(mode)
    if folders:
        writer = writer.partitionBy(*folders)
    writer.option("compression", COMPRESSION).format(file_format).save(path)


def write_parts(
    df: DataFrame, path: str, name: str = "part", max_fields: int = MAX_FIELDS,
    keys: list[str] | None = None, mode: str = "overwrite",
) -> list[str]:
    """A wide table as several stored tables of at most ``max_fields`` fields each."""
    parts = vertical_split(df, keys, max_fields, name)
    for part, table in parts.items():
        table.write.mode(mode).option("compression", COMPRESSION).parquet(f"{path}/{part}")
    return [f"{path}/{part}" for part in parts]


def read_parts(spark: SparkSession, paths: list[str], keys: list[str] | None = None) -> DataFrame:
    """The wide table behind stored parts; the keys must be unique."""
    return rejoin({p: spark.read.parquet(p) for p in paths}, keys)


def write_discard(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def write_text(payload: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-column payload as text files."""
    payload.write.mode(mode).text(path)
