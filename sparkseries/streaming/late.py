"""Late rows kept: given out beside the rows on time, and added to the windows they belong to.

A window is closed for a batch when the newest time of all earlier batches is ``delay`` past its
end. A row is late if its window is closed already. Counts of windows are kept as they change, a
summand for each batch, so late rows correct a closed window without its rows being read again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import TAG, TIME
from ..functions import bucket_start
from .batches import Part, exists, run_batches

MARKS = "batch bigint, newest bigint, watermark bigint, width bigint, delay bigint, rows bigint, late_rows bigint"


def late_stream(
    stream: DataFrame,
    path: str,
    field: str,
    width: int,
    delay: int,
    time: str = TIME,
    tag: str | None = TAG,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Store a stream below ``path`` with its late rows and the windows of ``field``.

    ``width`` and ``delay`` are in the unit of the integer ``time``, milliseconds by default. Rows
    without a time are on time and belong to no window; a null device is a device like others.
    What a batch takes as late depends on the batches before it alone, so a batch that is done
    again gives the same rows. No row of any batch is dropped, however late it is.
    """
    keys = [tag] if tag is not None else []
    columns = stream.columns

    def parts(batch: DataFrame, number: int) -> Iterator[Part]:
        spark = batch.sparkSession
        before = last_mark(spark, path, number)
        newest, watermark = (before["newest"], before["newest"] - delay) if before else (None, None)
        end = bucket_start(F.col(time), width) + F.lit(width).cast("bigint")
        late = F.coalesce(end <= F.lit(watermark).cast("bigint"), F.lit(False))
        yield Part("rows", batch.withColumn("late", late), folders=("late",))

        rows = _stored_rows(spark, f"{path}/rows/batch={number}", batch)
        yield Part("windows", (
            rows.where(F.col(time).isNotNull())
            .groupBy(*keys, bucket_start(F.col(time), width).alias("bucket"))
            .agg(
                F.count(F.when(~F.col("late"), F.col(field))).alias("points"),
                F.count(F.when(F.col("late"), F.col(field))).alias("late_points"),
            )
        ))
        yield Part("marks", rows.agg(
            F.greatest(F.max(time), F.lit(newest).cast("bigint")).alias("newest"),
            F.lit(watermark).cast("bigint").alias("watermark"),
            F.lit(width).cast("bigint").alias("width"),
            F.lit(delay).cast("bigint").alias("delay"),
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(F.col("late"), True)).alias("late_rows"),
        ).coalesce(1))

    if "late" in {c.lower() for c in columns} or "batch" in {c.lower() for c in columns}:
        raise ValueError("late and batch are columns of the result")
    return run_batches(stream, path, parts, checkpoint, available_now)


def _stored_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = like.withColumn("late", F.lit(True)).schema
    return spark.read.schema(schema).parquet(path)


def last_mark(spark: SparkSession, path: str, before: int | None = None):
    """The row of the newest batch (before a given one): newest time, watermark, rows, late rows."""
    if not exists(spark, f"{path}/marks"):
        return None
    marks = spark.read.schema(MARKS).parquet(f"{path}/marks").where("newest is not null")
    if before is not None:
        marks = marks.where(F.col("batch") < before)
    return marks.orderBy(F.desc("batch")).first()


def stored_rows(spark: SparkSession, path: str, late: bool | None = None) -> DataFrame:
    """Rows with ``batch`` and ``late``; only the late ones, or those on time, are a folder to read."""
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.withColumn("late", F.col("late").cast("string") == "true").withColumn(
        "batch", F.col("batch").cast("bigint")
    )
    return rows if late is None else rows.where(F.col("late") == late)


def window_totals(
    spark: SparkSession, path: str, tag: str | None = TAG, corrected: bool = True
) -> DataFrame:
    """Points of each window: ``points, late_points, corrections, closed``.

    ``points`` holds the late ones too unless ``corrected`` is false. ``corrections`` counts the
    batches that changed the window after it was closed; ``closed`` says whether it is now.
    """
    mark = last_mark(spark, path)
    keys = [tag] if tag is not None else []
    both = F.sum("points") + F.sum("late_points") if corrected else F.sum("points")
    totals = spark.read.parquet(f"{path}/windows").groupBy(*keys, "bucket").agg(
        both.alias("points"),
        F.sum("late_points").alias("late_points"),
        F.count(F.when(F.col("late_points") > 0, True)).alias("corrections"),
    )
    if mark is None:
        return totals.withColumn("closed", F.lit(False))
    next_watermark = F.lit(mark["newest"] - mark["delay"]).cast("bigint")
    return totals.withColumn("closed", F.col("bucket") + F.lit(mark["width"]) <= next_watermark)
