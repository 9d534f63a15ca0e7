"""Streams that write each batch into folders of its own, so that a repeated batch writes nothing twice.

A batch whose number is known from the checkpoint holds the same rows when it is given again, and
its folders are replaced as a whole. What it did is kept as a row beside them, for as long as the
table is kept, and no setting of the session is changed for it.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import TIME
from ..sinks.tables import with_time_chunk

PROGRESS = "batch bigint, records bigint, seconds double, records_per_s double, finished_ms bigint"


class Part(NamedTuple):
    """One of the tables that a batch writes: below ``<path>/<name>/batch=<number>``."""

    name: str
    rows: DataFrame
    file_format: str = "parquet"
    folders: tuple[str, ...] = ()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def run_batches(
    stream: DataFrame,
    path: str,
    parts: Callable[[DataFrame, int], Iterator[Part]],
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the ``parts`` of each batch of ``stream``, then its row of :func:`batch_progress`.

    ``parts(batch, number)`` gives the tables one after the other; a later one may read what an
    earlier one has written. The first is to be computed from the batch, and counts its records.
    A batch that failed anywhere before its end is done again as a whole. The checkpoint lies in the
    folder unless another is named.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, start = batch.sparkSession, clock.time()
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("records"))
        for part in parts(counted, number):
            writer = part.rows.write.mode("overwrite").format(part.file_format)
            if part.folders:
                writer = writer.partitionBy(*part.folders)
            writer.save(f"{path}/{part.name}/batch={number}")
        seconds, records = clock.time() - start, seen.get["records"]
        row = (number, records, seconds, records / max(seconds, 1e-9), int(clock.time() * 1000))
        done = spark.createDataFrame([row], PROGRESS).drop("batch")
        done.coalesce(1).write.mode("overwrite").json(f"{path}/progress/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint or f"{path}/checkpoint"
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def batch_progress(spark: SparkSession, path: str) -> DataFrame:
    """Records, seconds and rate of every batch that a table below ``path`` was ever given."""
    return spark.read.schema(PROGRESS).json(f"{path}/progress").select(*_names(PROGRESS))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def ingest_batches(
    stream: DataFrame,
    path: str,
    chunked: bool = True,
    time: str = TIME,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Rows of each batch as Parquet below ``<path>/rows``, in time chunks, with lasting progress."""

    def parts(batch: DataFrame, number: int) -> Iterator[Part]:
        if chunked:
            yield Part("rows", with_time_chunk(batch, time=time), folders=("time_chunk",))
        else:
            yield Part("rows", batch)

    return run_batches(stream, path, parts, checkpoint, available_now)


def payload_stream(
    stream: DataFrame,
    path: str,
    payload: Callable[[DataFrame], DataFrame],
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Messages of each batch as text, one per line, each message exactly once.

    ``payload`` makes a one-column table of messages from rows, such as
    :func:`~sparkseries.sinks.line_protocol`.
    """

    def parts(batch: DataFrame, number: int) -> Iterator[Part]:
        messages = payload(batch)
        yield Part("messages", messages.select(F.col(messages.columns[0]).alias("value")), "text")

    return run_batches(stream, path, parts, checkpoint, available_now)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, value)``: the messages that :func:`payload_stream` wrote."""
    return spark.read.schema("value string, batch bigint").text(f"{path}/messages").select("batch", "value")
