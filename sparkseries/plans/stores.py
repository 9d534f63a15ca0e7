"""Loads that are done once, clustered files, parts that join without a shuffle, windows kept up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import (
    age_windows,
    count_age_windows,
    moving_mean,
    update_age_windows,
)
from ..sinks import (
    count_loads,
    load_table,
    loaded_rows,
    read_joined_parts,
    scan_loads,
    write_joined_parts,
)
from ..storage import new_path
from .registry import EVENT_POINTS, event_points, registered, table
from .series import DAY, HOUR, JANUARY

THIRDS = "event_id % 3"
COLUMNS = ["time", "deviceId", "event_id", "event_type", "value"]


def _thirds(spark, sf_dir):
    rows = event_points(spark, sf_dir).select(*COLUMNS)
    return [rows.where(F.pmod(F.col("event_id"), F.lit(3)) == i) for i in range(3)]


def _loaded(spark, sf_dir, name):
    """Three loads, one of them given twice, in files of 500 rows."""
    path = new_path(spark, name)
    for number, rows in enumerate(_thirds(spark, sf_dir)):
        for _ in range(2 if number == 1 else 1):
            load_table(rows, path, f"load-{number}", rows_per_file=500, fields=["value"])
    return path


@registered("load_once", f"""
    select "time", "deviceId", event_id, event_type, value, 'load-' || {THIRDS} as load,
           "time" // 604800000 * 604800000 as time_chunk from ({EVENT_POINTS})""")
def load_once(spark, sf_dir):
    """Three loads appended, one of them given again: every row once."""
    return loaded_rows(spark, _loaded(spark, sf_dir, "loads")).select(*COLUMNS, "load", "time_chunk")


@registered("load_overwrite", f"""
    select "time", "deviceId", event_id, event_type, value from ({EVENT_POINTS}) where {THIRDS} <> 0""")
def load_overwrite(spark, sf_dir):
    """A table loaded, written over by a second load and added to by a third."""
    path, thirds = new_path(spark, "loads"), _thirds(spark, sf_dir)
    for number, mode in enumerate(["append", "overwrite", "append"]):
        load_table(thirds[number], path, f"load-{number}", mode)
    return loaded_rows(spark, path).select(*COLUMNS)


@registered("clustered_device_scan", f"""
    select "time", "deviceId", event_type, value from ({EVENT_POINTS})
    where "deviceId" = 'root.u8' and "time" between {JANUARY + 3 * DAY} and {JANUARY + 20 * DAY}""")
def clustered_device_scan(spark, sf_dir):
    """One device and time range, from the files that can hold it."""
    return scan_loads(
        spark, _loaded(spark, sf_dir, "clustered"), ["event_type", "value"], "root.u8",
        JANUARY + 3 * DAY, JANUARY + 20 * DAY,
    )


# Ranges of devices and times: inside a chunk, over many, along chunk borders, open, empty.
CHUNK = 604_800_000
FIRST_CHUNK = JANUARY // CHUNK * CHUNK
RANGES = [
    ("root.u1", "root.u5", JANUARY + 7 * HOUR, JANUARY + 9 * HOUR),
    ("root.u2", "root.u7", JANUARY + DAY + 1, JANUARY + 27 * DAY + 12_345),
    (None, "root.u4", FIRST_CHUNK + CHUNK, FIRST_CHUNK + 3 * CHUNK - 1),
    ("root.u3", None, FIRST_CHUNK + CHUNK + 1, FIRST_CHUNK + 3 * CHUNK),
    (None, None, None, JANUARY + 11 * DAY),
    ("root.u10", "root.u20", JANUARY + 13 * DAY, None),
    ("root.u5", "root.u1", None, None),
]


def _in_range(first, last, start, end):
    tests = [
        f"\"deviceId\" >= '{first}'" if first else "", f"\"deviceId\" <= '{last}'" if last else "",
        f'"time" >= {start}' if start is not None else "", f'"time" <= {end}' if end is not None else "",
    ]
    return " and ".join(t for t in tests if t) or "true"


@registered("range_counts", " union all ".join(
    f"select {i} as range, count(value) as points from ({EVENT_POINTS}) where {_in_range(*r)}"
    for i, r in enumerate(RANGES)
))
def range_counts(spark, sf_dir):
    """Points by range of devices and time: whole chunks from stored counts, edges from rows."""
    path = _loaded(spark, sf_dir, "counted")
    found = [
        count_loads(spark, path, "value", *r).select(F.lit(i).alias("range"), "points")
        for i, r in enumerate(RANGES)
    ]
    return reduce(lambda a, b: a.union(b), found)


@registered("range_counts_per_device", f"""
    select "deviceId", count(value) as points from ({EVENT_POINTS})
    where {_in_range(*RANGES[1])} group by 1""")
def range_counts_per_device(spark, sf_dir):
    return count_loads(spark, _loaded(spark, sf_dir, "counted"), "value", *RANGES[1], by_device=True)


@registered("joined_parts", """
    select case when o_custkey % 7 <> 0 then o_custkey end as customer, o_orderpriority, o_orderkey,
           o_orderstatus, o_totalprice, o_orderdate
    from orders""")
def joined_parts(spark, sf_dir):
    """Orders by customer, many repeated and some null, in parts of two fields and together again."""
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("customer"), "o_orderpriority",
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
    )
    path = new_path(spark, "joined")
    write_joined_parts(orders, path, ["customer", "o_orderpriority"], max_fields=2, buckets=8)
    return read_joined_parts(spark, path)


AGE_WINDOWS = f"""
    units as (
        select event_type, "time" // {HOUR} as unit, (select max("time") // {HOUR} from ({EVENT_POINTS})) as now
        from ({EVENT_POINTS})
    ), levelled as (
        select event_type, unit, coalesce(list_max(list_filter(range(0, 41), lambda k:
                   now + 1 - ((unit >> k) + 1) * (1::bigint << k) >= (1::bigint << k))), 0)::int as level
        from units
    ), windows as (
        select event_type, (unit >> level << level) * {HOUR} as start, level,
               ((unit >> level << level) + (1::bigint << level)) * {HOUR} as until, count(*) as points
        from levelled group by all
    )
"""


def _aged(spark, sf_dir):
    path = new_path(spark, "aged")
    for number, rows in enumerate(_thirds(spark, sf_dir)):
        for _ in range(2 if number == 1 else 1):
            update_age_windows(rows, path, f"load-{number}", HOUR, "time", keys=["event_type"])
    return path


@registered("age_windows", f"""
    with {AGE_WINDOWS} select event_type, start, until, level, points from windows""")
def age_windows_of_loads(spark, sf_dir):
    """Windows that double with age, kept up over three loads: as if made of all rows at the end."""
    return age_windows(spark, _aged(spark, sf_dir))


AGE_START, AGE_END = JANUARY + 5 * DAY + 17, JANUARY + 26 * DAY + 5 * HOUR + 1


@registered("age_window_counts", f"""
    with {AGE_WINDOWS}, exact as (
        select event_type, count(*) as exact from ({EVENT_POINTS})
        where "time" >= {AGE_START} and "time" < {AGE_END} group by 1)
    select event_type, coalesce(sum(points) filter (where start >= {AGE_START} and until <= {AGE_END}), 0)::bigint as least,
           sum(points)::bigint as most, any_value(exact) as exact, true as between
    from windows join exact using (event_type) where start < {AGE_END} and until > {AGE_START}
    group by event_type""")
def age_window_counts(spark, sf_dir):
    """Counts with their bounds, beside the exact ones, which lie between them."""
    found = count_age_windows(spark, _aged(spark, sf_dir), AGE_START, AGE_END, ["event_type"])
    exact = event_points(spark, sf_dir).where(
        (F.col("time") >= AGE_START) & (F.col("time") < AGE_END)
    ).groupBy("event_type").agg(F.count(F.lit(1)).alias("exact"))
    held = F.expr("exact between least and most and estimate between least and most")
    return found.join(exact, "event_type").select("event_type", "least", "most", "exact", held.alias("between"))


@registered("moving_mean", f"""
    select event_id, row_number() over w as row_no, avg(floor(value * 1000)::bigint) over r as mean,
           count(value) over r as n
    from ({EVENT_POINTS})
    window w as (order by "time", event_id), r as (order by "time", event_id rows between 999 preceding and current row)""")
def moving_mean_of_all(spark, sf_dir):
    """At every event the mean of the last thousand."""
    rows = event_points(spark, sf_dir).select(
        "time", "event_id", F.floor(F.col("value") * 1000).cast("bigint").alias("value"))
    found = moving_mean(rows, "value", ["time", "event_id"], 1000)
    return found.select("event_id", F.col("row_no").cast("bigint").alias("row_no"), "mean", "n")


@registered("moving_mean_per_device", f"""
    select "deviceId", event_id, avg(floor(value * 1000)::bigint) over r as mean, count(value) over r as n
    from ({EVENT_POINTS})
    window r as (partition by "deviceId" order by "time", event_id rows between 4 preceding and current row)""")
def moving_mean_per_device(spark, sf_dir):
    rows = event_points(spark, sf_dir).select(
        "time", "deviceId", "event_id", F.floor(F.col("value") * 1000).cast("bigint").alias("value"))
    found = moving_mean(rows, "value", ["time", "event_id"], 5, ["deviceId"])
    return found.select("deviceId", "event_id", "mean", "n")
