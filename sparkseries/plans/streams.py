"""Streams over the given tables, run to their end; what they stored is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import epoch_ms
from ..storage import new_path
from ..sinks import line_protocol
from ..streaming import (
    batch_progress,
    downsample_stream,
    ingest_batches,
    ingest_stream,
    late_stream,
    payload_stream,
    read_messages,
    read_stream,
    stored_rows,
    window_totals,
)
from .registry import EVENT_POINTS, registered, table


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return read_stream(spark, f"{sf_dir}/events.parquet", schema).select(
        epoch_ms(F.col("ts")).alias("time"),
        F.concat(F.lit("root.u"), F.col("user_id").cast("string")).alias("deviceId"),
        "event_type", "value",
    )


@registered("stream_ingest", f"""
    select "time", "deviceId", event_type, value,
           "time" // 604800000 * 604800000 as time_chunk from ({EVENT_POINTS})""")
def stream_ingest(spark, sf_dir):
    path = new_path(spark, "ingested")
    ingest_stream(_event_stream(spark, sf_dir), path).awaitTermination()
    return spark.read.parquet(path).select(
        "time", "deviceId", "event_type", "value",
        F.col("time_chunk").cast("bigint").alias("time_chunk"),
    )


@registered("stream_downsample", f"""
    with points as ({EVENT_POINTS})
    select event_type, "time" // 3600000 * 3600000 as bucket, count(value) as points
    from points group by 1, 2
    having "time" // 3600000 * 3600000 + 3600000
           <= (select max("time") - 600000 from points)""")
def stream_downsample(spark, sf_dir):
    """Windows that the watermark has closed; the newest ones stay open at the end."""
    path = new_path(spark, "downsampled")
    counted = downsample_stream(
        _event_stream(spark, sf_dir), "value", "1 hour", "10 minutes", tag="event_type"
    )
    ingest_stream(counted, path, chunked=False).awaitTermination()
    return spark.read.parquet(path)


@registered("stream_ingest_restart", f"""
    select "time", "deviceId", event_type, value from ({EVENT_POINTS})""")
def stream_ingest_restart(spark, sf_dir):
    """Two loads into one table, the second of files that came later."""
    source, path = new_path(spark, "arrived"), new_path(spark, "ingested")
    events = table(spark, sf_dir, "events")
    late = F.pmod(F.col("event_id"), F.lit(3)) == 0
    for part in (~late, late):
        events.where(part).write.mode("append").parquet(source)
        rows = read_stream(spark, source, events.schema).select(
            epoch_ms(F.col("ts")).alias("time"),
            F.concat(F.lit("root.u"), F.col("user_id").cast("string")).alias("deviceId"),
            "event_type", "value",
        )
        ingest_stream(rows, path, chunked=False).awaitTermination()
    return spark.read.parquet(path)


# Events arrive in three parts by time; each tenth one comes a part later.
TWELFTH, TWENTY_FOURTH = 1_705_017_600_000, 1_706_054_400_000
HOUR, DELAY = 3_600_000, 600_000
ARRIVAL = f"""
    arrived as (
        select *, least(2, ("time" >= {TWELFTH})::int + ("time" >= {TWENTY_FOURTH})::int
                           + (event_id % 10 = 0)::int) as part,
               "time" // {HOUR} * {HOUR} as bucket
        from ({EVENT_POINTS})
    ), marked as (
        select a.*, bucket + {HOUR} <= (select max(b."time") - {DELAY} from arrived b where b.part < a.part) as late
        from arrived a
    ), judged as (
        select * replace (coalesce(late, false) as late) from marked
    )
"""


def _arriving(spark, sf_dir, run):
    """Give the parts to ``run(stream)`` one after the other, each as a stream of what is new."""
    source = new_path(spark, "arrived")
    events = table(spark, sf_dir, "events").withColumn("time", epoch_ms(F.col("ts")))
    part = F.least(
        F.lit(2),
        (F.col("time") >= TWELFTH).cast("int") + (F.col("time") >= TWENTY_FOURTH).cast("int")
        + (F.pmod(F.col("event_id"), F.lit(10)) == 0).cast("int"),
    )
    for number in range(3):
        events.where(part == number).write.mode("append").parquet(source)
        rows = read_stream(spark, source, events.schema).select(
            "time", F.concat(F.lit("root.u"), F.col("user_id").cast("string")).alias("deviceId"),
            "event_id", "event_type", "value",
        )
        run(rows).awaitTermination()


def _late(spark, sf_dir):
    path = new_path(spark, "late")
    _arriving(spark, sf_dir, lambda rows: late_stream(
        rows, path, "value", HOUR, DELAY, tag="event_type"))
    return path


@registered("stream_late_rows", f"""
    with {ARRIVAL}
    select "time", "deviceId", event_id, event_type, value, late from judged""")
def stream_late_rows(spark, sf_dir):
    """Every row of every part, with whether it came after its window was closed."""
    rows = stored_rows(spark, _late(spark, sf_dir))
    return rows.select("time", "deviceId", "event_id", "event_type", "value", "late")


@registered("stream_late_windows", f"""
    with {ARRIVAL}
    select event_type, bucket, count(value) as points,
           count(value) filter (where late) as late_points,
           count(distinct part) filter (where late and value is not null) as corrections,
           bucket + {HOUR} <= (select max("time") - {DELAY} from arrived) as closed
    from judged group by event_type, bucket""")
def stream_late_windows(spark, sf_dir):
    """Windows with the late rows that corrected them: the same totals as of all rows at once."""
    return window_totals(spark, _late(spark, sf_dir), tag="event_type")


@registered("stream_messages", f"""
    with {ARRIVAL}
    select part::bigint as batch,
           'tb1,deviceId=' || "deviceId" || ' value=' || value::decimal(18,2) || ' ' || "time" * 1000000 as message
    from arrived where value is not null""")
def stream_messages(spark, sf_dir):
    """Messages of three batches, the number of the batch beside each."""
    path = new_path(spark, "messages")

    def lines(rows):
        return line_protocol(
            rows.select("time", "deviceId", F.col("value").cast("decimal(18,2)").alias("value")))

    _arriving(spark, sf_dir, lambda rows: payload_stream(rows, path, lines))
    return read_messages(spark, path).withColumnRenamed("value", "message")


@registered("stream_progress", f"""
    with {ARRIVAL}
    select part::bigint as batch, count(*) as records, true as timed from arrived group by part""")
def stream_progress(spark, sf_dir):
    """Records of every batch over three runs of a stream, from the rows kept beside the table."""
    path = new_path(spark, "ingested")
    _arriving(spark, sf_dir, lambda rows: ingest_batches(rows, path))
    timed = (F.col("seconds") > 0) & (F.col("records_per_s") > 0) & (F.col("finished_ms") > 0)
    return batch_progress(spark, path).select("batch", "records", timed.alias("timed"))
