"""Query shapes and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (
    age_rollup,
    align_long_query,
    align_query,
    batch_latency,
    count_query,
    count_range,
    downsample,
    keep_last,
    latency_report,
    load_report,
    range_scan_count,
    raw_query,
    result_size,
)
from ..operators.reports import FINISHED_QUERY
from ..sinks import TIME_CHUNK_MS, write_table, write_text
from ..sources import number_lines, read_lines, scan_orc, scan_parquet
from ..storage import new_path
from .registry import EVENT_POINTS, event_points, registered, table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# January 2024 in epoch milliseconds, the span of the events.
JANUARY, FEBRUARY = 1_704_067_200_000, 1_706_745_600_000
TENTH, TWENTIETH = 1_704_844_800_000, 1_705_708_800_000
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


@registered("raw_limit", """
    select ts, value from events where value is not null order by ts, value limit 1000""")
def raw_limit(spark, sf_dir):
    return raw_query(table(spark, sf_dir, "events"), "value", 1000, time="ts", tag=None)


@registered("raw_limit_large", """
    select l_shipdate, l_quantity from lineitem where l_quantity is not null
    order by l_shipdate, l_quantity limit 25000""")
def raw_limit_large(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return raw_query(lineitem, "l_quantity", 25_000, time="l_shipdate", tag=None)


@registered("raw_per_device", """
    select user_id, ts, value from events where value is not null
    qualify row_number() over (partition by user_id order by ts, value) <= 10""")
def raw_per_device(spark, sf_dir):
    return raw_query(table(spark, sf_dir, "events"), "value", 10, time="ts", tag="user_id")


@registered("align_wide", """
    select l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax from lineitem
    where coalesce(l_quantity, l_extendedprice, l_discount, l_tax) is not null""")
def align_wide(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return align_query(lineitem, SENSORS, time="l_shipdate", tag="l_suppkey")


@registered("align_long", "select user_id, ts, " + ", ".join(
    f"max(value) filter (where event_type = '{e}') as {e}" for e in EVENT_TYPES
) + " from events group by user_id, ts")
def align_long(spark, sf_dir):
    return align_long_query(
        table(spark, sf_dir, "events"), EVENT_TYPES, time="ts", tag="user_id", name="event_type"
    )


@registered("count_until", """
    select user_id, count(value) as points from events
    where ts <= timestamp '2024-01-20 00:00:00' group by user_id""")
def count_until(spark, sf_dir):
    return count_query(
        table(spark, sf_dir, "events"), "value", TWENTIETH, time="ts", tag="user_id"
    )


@registered("count_all", """
    select count(value) as points from events where ts <= timestamp '2024-02-01 00:00:00'""")
def count_all(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return count_query(events, "value", FEBRUARY, time="ts", tag=None)


@registered("count_range", """
    select user_id, count(value) as points from events
    where ts >= timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-20 00:00:00'
    group by user_id""")
def count_in_range(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return count_range(events, "value", TENTH, TWENTIETH, time="ts", tag="user_id")


@registered("downsample_epoch", """
    select (epoch_us(ts) // 1000) // 3600000 * 3600000 as bucket, count(value) as points
    from events
    where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
    group by 1""")
def downsample_epoch(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(events, "value", JANUARY, FEBRUARY, HOUR, time="ts", tag=None)


@registered("downsample_per_device", """
    select user_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 as bucket,
           count(value) as points
    from events
    where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
    group by 1, 2""")
def downsample_per_device(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(events, "value", JANUARY, FEBRUARY, DAY, time="ts", tag="user_id")


@registered("downsample_origin", """
    select (epoch_us(ts) // 1000 - 1704067200000) // 604800000 * 604800000 + 1704067200000
           as bucket, count(value) as points
    from events
    where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
    group by 1""")
def downsample_origin(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(
        events, "value", JANUARY, FEBRUARY, 7 * DAY, time="ts", tag=None, origin=JANUARY
    )


@registered("downsample_fill", """
    with counted as (
        select (epoch_us(ts) // 1000) // 60000 * 60000 as bucket, count(value) as points
        from events
        where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
        group by 1)
    select g.bucket, coalesce(points, 0) as points
    from (select unnest(generate_series(1704067200000, 1706745599999, 60000)) as bucket) g
    left join counted using (bucket)""")
def downsample_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(
        events, "value", JANUARY, FEBRUARY, MINUTE, time="ts", tag=None, fill=True
    )


@registered("downsample_fill_per_device", """
    with counted as (
        select user_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 as bucket,
               count(value) as points
        from events
        where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
        group by 1, 2),
    grid as (
        select u.user_id, g.bucket
        from (select distinct user_id from counted) u,
             (select unnest(generate_series(1704067200000, 1706745599999, 86400000))
              as bucket) g)
    select user_id, bucket, coalesce(points, 0) as points
    from grid left join counted using (user_id, bucket)""")
def downsample_fill_per_device(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(
        events, "value", JANUARY, FEBRUARY, DAY, time="ts", tag="user_id", fill=True
    )


@registered("downsample_stats", """
    select user_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 as bucket,
           count(value) as points, min(value) as "min", max(value) as "max"
    from events
    where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
    group by 1, 2""")
def downsample_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(
        events, "value", JANUARY, FEBRUARY, DAY, time="ts", tag="user_id",
        aggregates=("count", "min", "max"),
    )


@registered("keep_last", """
    select l_suppkey, l_shipdate, l_quantity, l_orderkey, l_extendedprice
    from (select l_suppkey, l_shipdate, l_quantity, l_orderkey, l_extendedprice,
                 row_number() over (partition by l_suppkey, l_shipdate
                     order by l_orderkey desc, l_quantity desc, l_extendedprice desc) as n
          from lineitem)
    where n = 1""")
def keep_last_version(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_orderkey", "l_extendedprice"
    )
    return keep_last(rows, "l_orderkey", time="l_shipdate", tag="l_suppkey")


@registered("range_scan_count", """
    select count(*) as lines from lineitem
    where l_shipdate >= timestamp '1996-01-01' and l_shipdate <= timestamp '1999-12-31'""")
def range_scan(spark, sf_dir):
    return range_scan_count(
        table(spark, sf_dir, "lineitem"), "l_quantity", "1996-01-01T00:00:00",
        "1999-12-31T00:00:00", time="l_shipdate", tag="l_suppkey",
    )


@registered("suffix_scan_count", """
    select count(*) as lines from events where ends_with(cast(user_id as varchar), '8')""")
def suffix_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return range_scan_count(events, "value", suffix="8", time="ts", tag="user_id")


@registered("scan_parquet", f"""
    select "time", "deviceId", value from ({EVENT_POINTS})
    where "time" >= {TENTH} and "time" <= {TWENTIETH}""")
def stored_parquet(spark, sf_dir):
    path = new_path(spark, "scan-parquet")
    write_table(event_points(spark, sf_dir), path, "parquet", "chunk")
    return scan_parquet(spark, path, ["value"], TENTH, TWENTIETH, chunk=TIME_CHUNK_MS)


@registered("scan_orc", f"""
    select "time", "deviceId", value from ({EVENT_POINTS})
    where "time" >= {TENTH} and "time" <= {TWENTIETH} and ends_with("deviceId", '8')""")
def stored_orc(spark, sf_dir):
    path = new_path(spark, "scan-orc")
    write_table(event_points(spark, sf_dir), path, "orc", "single")
    return scan_orc(spark, path, ["value"], TENTH, TWENTIETH, suffix="8")


@registered("result_size", """
    select count(*) as lines, count(*) * 4 as points, count(*) * 5 as cells
    from lineitem""")
def size_of_result(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    result = align_query(lineitem, SENSORS, time="l_shipdate", tag=None)
    return result_size(result).select("lines", "points", "cells")


@registered("load_report", """
    select count(distinct l_suppkey) as files, count(*) as records, count(*) * 4 as points,
           count(l_quantity) + count(nullif(l_discount, 0)) + count(l_tax)
               + count(l_extendedprice) as present_points,
           (select cast(sum((n + 99) // 100) as bigint)
            from (select count(*) as n from lineitem group by l_suppkey)) as batches
    from lineitem""")
def report_of_load(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").withColumn(
        "l_discount", F.nullif("l_discount", F.lit(0.0))
    )
    return load_report(lineitem, SENSORS, F.col("l_suppkey").cast("string"), batch_rows=100)


@registered("batch_latency", """
    select round((select avg(o_totalprice / 1000000.0) from orders), 9) as avg_all_ms,
           round(avg(o_totalprice / 1000000.0), 9) as avg_last_ms, count(*) as n_last
    from (select o_totalprice from orders order by o_orderkey desc limit 10000)""")
def latency_of_batches(spark, sf_dir):
    report = batch_latency(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"])
    return report.select(
        F.round("avg_all_ms", 9).alias("avg_all_ms"),
        F.round("avg_last_ms", 9).alias("avg_last_ms"),
        "n_last",
    )


@registered("latency_report", "select event_id // 6 as query_parameter, " + ", ".join(
    f"max(value) filter (where event_id % 6 = {i}) as repeat{i + 1}" for i in range(6)
) + ", round(avg(value), 9) as average_ms from events group by 1")
def report_of_latencies(spark, sf_dir):
    """A query log written from the events: six runs of each parameter."""
    events = table(spark, sf_dir, "events")
    line = F.concat(
        F.lit("[INFO ] main Exp:\"QUERY\" done! Query Param:"),
        F.expr("event_id div 6").cast("string"), F.lit(". query time: "),
        F.col("value").cast("string"), F.lit(" ms"),
    )
    path = new_path(spark, "query-log")
    log = events.repartitionByRange("event_id").sortWithinPartitions("event_id")
    write_text(log.select(line.alias("value")), path)
    lines = number_lines(read_lines(spark, path), F.col("value").rlike(FINISHED_QUERY))
    report = latency_report(lines, ["file", "line_no"], repeats=6)
    return report.withColumn("average_ms", F.round("average_ms", 9))


@registered("age_rollup", f"""
    select event_type, length(bin(({FEBRUARY} - "time") // 3600000 + 1)) - 1 as "window",
           count(*) as points
    from ({EVENT_POINTS}) where "time" <= {FEBRUARY} group by 1, 2""")
def rollup_by_age(spark, sf_dir):
    points = event_points(spark, sf_dir)
    report = age_rollup(points, FEBRUARY, HOUR, "time", ["event_type"])
    return report.withColumn("window", F.col("window").cast("bigint"))


# One device, as in every live query of a dashboard.
@registered("raw_one_device", """
    select ts, value from events where user_id = 8 and value is not null
    order by ts, value limit 20""")
def raw_one_device(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return raw_query(events, "value", 20, device=8, time="ts", tag="user_id")


@registered("align_one_device", f"""
    select l_shipdate, {", ".join(SENSORS)} from lineitem
    where l_suppkey = 7 and coalesce({", ".join(SENSORS)}) is not null""")
def align_one_device(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return align_query(lineitem, SENSORS, device=7, time="l_shipdate", tag="l_suppkey")


@registered("count_one_device", """
    select count(value) as points from events
    where user_id = 8 and ts <= timestamp '2024-02-01 00:00:00'""")
def count_one_device(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return count_query(events, "value", FEBRUARY, device=8, time="ts", tag="user_id")


@registered("downsample_one_device", """
    select (epoch_us(ts) // 1000) // 3600000 * 3600000 as bucket, count(value) as points
    from events where user_id = 8 and ts >= timestamp '2024-01-01 00:00:00'
      and ts < timestamp '2024-02-01 00:00:00' group by 1""")
def downsample_one_device(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return downsample(
        events, "value", JANUARY, FEBRUARY, HOUR, device=8, time="ts", tag="user_id"
    )


@registered("downsample_fill_null_device", """
    with named as (select *, case when user_id % 7 = 0 then null else user_id end as device from events),
    counted as (
        select device, (epoch_us(ts) // 1000) // 86400000 * 86400000 as bucket, count(value) as points
        from named
        where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-02-01 00:00:00'
        group by 1, 2),
    grid as (
        select u.device, g.bucket
        from (select distinct device from counted) u,
             (select unnest(generate_series(1704067200000, 1706745599999, 86400000)) as bucket) g)
    select g.device, g.bucket, coalesce(points, 0) as points
    from grid g left join counted c
      on g.device is not distinct from c.device and g.bucket = c.bucket""")
def downsample_fill_null_device(spark, sf_dir):
    """Points without a device are a series of their own, also when empty buckets are filled."""
    events = table(spark, sf_dir, "events").withColumn(
        "device", F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    )
    return downsample(
        events, "value", JANUARY, FEBRUARY, DAY, time="ts", tag="device", fill=True
    )


@registered("latency_repeats", """
    select event_id // 6 as query_parameter, event_id % 6 + 1 as repeat, value as latency,
           round(avg(value) over (partition by event_id // 6), 9) as average_ms from events""")
def latency_repeats(spark, sf_dir):
    """The log of latency_report with a row for each repeat."""
    log = table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("done! Query Param:"), F.expr("event_id div 6").cast("string"),
            F.lit(". query time: "), F.col("value").cast("string"), F.lit(" ms"),
        ).alias("value"),
        "event_id",
    )
    return latency_report(log, ["event_id"]).withColumn("average_ms", F.round("average_ms", 9))
