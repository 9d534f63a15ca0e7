"""Structured Streaming: loading file by file, and windowed counts with late-data rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import TAG, TIME
from ..sinks.tables import with_time_chunk

# How many batches' progress a query keeps; Spark's default forgets all but 100.
PROGRESS_ENTRIES = "spark.sql.streaming.numRecentProgressUpdates"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files below a path as a stream; ``text`` gives raw lines."""
    reader = spark.readStream.format(file_format).option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest_stream(
    stream: DataFrame,
    path: str,
    file_format: str = "parquet",
    checkpoint: str | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    chunked: bool = True,
    available_now: bool = True,
    time: str = TIME,
) -> StreamingQuery:
    """Append a stream to a stored table; the file sink writes every record exactly once.

    The checkpoint belongs to the table and lies in its folder unless another is named, so a later
    call goes on where the last one ended. A new checkpoint for a table that a stream has
    written would make the sink skip batches, and is refused. Progress of all batches is kept.
    """
    table = transform(stream) if transform else stream
    if chunked:
        table = with_time_chunk(table, time=time)
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{path}/_checkpoint"
    if _exists(spark, f"{path}/_spark_metadata") and not _exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{path} was written by a stream with another checkpoint")
    writer = (
        table.writeStream.format(file_format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if chunked:
        writer = writer.partitionBy("time_chunk")
    if available_now:
        writer = writer.trigger(availableNow=True)
    # Queries read this setting of the session as they run, so it stays.
    spark.conf.set(PROGRESS_ENTRIES, 2**31 - 1)
    return writer.start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def downsample_stream(
    stream: DataFrame,
    field: str,
    width: str,
    delay: str = "10 minutes",
    device: str | None = None,
    time: str = TIME,
    tag: str | None = TAG,
) -> DataFrame:
    """Points per epoch-aligned window; rows later than ``delay`` behind the newest are dropped.

    ``time`` is epoch milliseconds or a TIMESTAMP column. A window is final, and is
    given out in append mode, once the watermark has passed its end.
    """
    rows = stream if device is None else stream.where(F.col(tag) == F.lit(device))
    keys = [tag] if device is None and tag is not None else []
    kind = dict(stream.dtypes)[time]
    moment = F.timestamp_millis(time) if kind == "bigint" else F.col(time).cast("timestamp")
    counted = (
        rows.withColumn("__moment", moment)
        .withWatermark("__moment", delay)
        .groupBy(*keys, F.window("__moment", width).alias("__window"))
        .agg(F.count(field).alias("points"))
    )
    return counted.select(
        *keys, F.unix_millis("__window.start").alias("bucket"), "points"
    )


def progress_report(query: StreamingQuery) -> list[dict]:
    """Records, rates and times of the batches a stream has done, as its running log."""
    rows = []
    for p in query.recentProgress:
        rows.append({
            "batch": p["batchId"],
            "records": p["numInputRows"],
            "records_per_s": p.get("processedRowsPerSecond"),
            "batch_ms": p["durationMs"].get("triggerExecution"),
        })
    return rows
