"""A stored list of device names by their ends, so that a suffix is a prefix that reaches the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from .stored import _scan, open_table

# So many names are a filter of the scan; more are joined.
LISTED_DEVICES = 10_000


def update_device_names(df: DataFrame, path: str, mode: str = "append", tag: str = TAG) -> None:
    """Add the devices of ``df`` to the list at ``path``, or make it anew (``overwrite``).

    Names are stored with their reverse and sorted by it. Names that are there are not added again; if a
    load that is repeated adds some twice, the readers still give them once. A null device has no name.
    """
    device = F.col(f"`{tag}`").cast("string")
    names = df.select(device.alias("device")).where("device is not null").distinct()
    if mode == "append":
        names = names.join(df.sparkSession.read.parquet(path).select("device"), "device", "left_anti")
    names = names.withColumn("backward", F.reverse("device")).repartitionByRange("backward")
    names.sortWithinPartitions("backward").write.mode(mode).parquet(path)


def devices_ending(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``(device)``: the listed devices whose names end with ``suffix``; the empty suffix gives all."""
    names = spark.read.parquet(path).where(F.col("backward").startswith(suffix[::-1]))
    return names.select("device").distinct()


def scan_suffix(
    spark: SparkSession, path: str, names: str, fields: list[str], suffix: str,
    start: int | None = None, end: int | None = None, file_format: str = "parquet", time: str = TIME,
    tag: str = TAG, chunk: int | None = None,
) -> DataFrame:
    """Rows of the devices whose names end with ``suffix``, as :func:`scan_parquet` gives them.

    Few devices are a filter that is pushed to the reader (and skips folders of devices); more are a
    semi join. ``names`` must list the devices of the table (:func:`update_device_names`).
    """
    rows = _scan(open_table(spark, path, file_format), fields, start, end, None, None, time, tag, chunk)
    found = devices_ending(spark, names, suffix)
    listed = [r.device for r in found.limit(LISTED_DEVICES + 1).collect()]
    if len(listed) <= LISTED_DEVICES:
        return rows.where(F.col(tag).isin(listed))
    return rows.join(found.withColumnRenamed("device", tag), tag, "left_semi").select(*rows.columns)
