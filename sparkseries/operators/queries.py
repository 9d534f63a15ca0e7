"""The four query shapes and the range scans.

``device`` selects one device, ``device=None`` answers for every device at once,
and ``tag=None`` says that the table is one series. Bounds are compared with the
stored time column itself, so they reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions import bucket_start, epoch_ms, time_bound
from ..storage import join_null_safe
from .layout import null_skip, spread
from .ranking import first_rows, first_rows_per_group

BUCKETS_PER_RUN = 100_000

# Statistics of a bucket beyond the count; an addition to the plain count queries.
AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
}


def _of_device(df: DataFrame, device, tag: str | None) -> DataFrame:
    return df if device is None else df.where(F.col(tag) == F.lit(device))


def _groups(device, tag: str | None) -> list[str]:
    return [tag] if device is None and tag is not None else []


def between(
    df: DataFrame, start=None, end=None, time: str = TIME, closed: bool = True
) -> DataFrame:
    """Rows of ``[start, end]`` (or ``[start, end)``); a missing bound is open."""
    if start is not None:
        df = df.where(F.col(time) >= time_bound(df, time, start))
    if end is not None:
        bound = time_bound(df, time, end)
        df = df.where(F.col(time) <= bound if closed else F.col(time) < bound)
    return df


def raw_query(
    df: DataFrame,
    field: str,
    n: int,
    device=None,
    time: str = TIME,
    tag: str | None = TAG,
    include_null: bool = False,
) -> DataFrame:
    """The first ``n`` points in time of one series, or of each device's series."""
    keys = _groups(device, tag)
    points = _of_device(df, device, tag)
    if not include_null:
        points = points.where(F.col(field).isNotNull())
    points = points.select(*keys, time, field)
    if keys:
        return first_rows_per_group(points, keys, [time], n)
    return first_rows(points, [time], n)


def align_query(
    df: DataFrame, fields: list[str], device=None, time: str = TIME, tag: str | None = TAG
) -> DataFrame:
    """Several sensors of a wide table side by side; rows where at least one is present."""
    rows = _of_device(df, device, tag).select(*_groups(device, tag), time, *fields)
    return null_skip(rows, fields)


def align_long_query(
    df: DataFrame,
    series: list,
    device=None,
    time: str = TIME,
    tag: str | None = TAG,
    name: str = "field",
    value: str = "value",
) -> DataFrame:
    """Several series of a long table joined on time; one column per listed series.

    Points that share series and time are represented by their largest value.
    """
    points = _of_device(df, device, tag).where(F.col(value).isNotNull())
    return spread(points, [*_groups(device, tag), time], name, series, value)


def count_query(
    df: DataFrame, field: str, until, device=None, time: str = TIME, tag: str | None = TAG
) -> DataFrame:
    """Number of present points with ``time <= until``."""
    return count_range(df, field, None, until, device, time, tag)


def count_range(
    df: DataFrame,
    field: str,
    start=None,
    end=None,
    device=None,
    time: str = TIME,
    tag: str | None = TAG,
) -> DataFrame:
    """Number of present points in a closed time range; a missing bound is open."""
    rows = between(_of_device(df, device, tag), start, end, time)
    return rows.groupBy(*_groups(device, tag)).agg(F.count(field).alias("points"))


def downsample(
    df: DataFrame,
    field: str,
    start: int,
    end: int,
    width: int,
    device=None,
    time: str = TIME,
    tag: str | None = TAG,
    origin: int = 0,
    fill: bool = False,
    aggregates: tuple[str, ...] = ("count",),
) -> DataFrame:
    """Points per time bucket over ``[start, end)``, all in epoch milliseconds.

    Buckets start at ``origin`` plus a multiple of ``width`` (epoch aligned by
    default) and are returned as ``bucket BIGINT``. Only buckets that hold rows
    are returned unless ``fill`` asks for the empty ones too, with count 0.
    """
    keys = _groups(device, tag)
    rows = between(_of_device(df, device, tag), start, end, time, closed=False)
    start_of, as_ms = _bucket(df, time, width, origin)
    counted = (
        rows.withColumn("bucket", start_of)
        .groupBy(*keys, "bucket")
        .agg(*[AGGREGATES[a](field).alias("points" if a == "count" else a) for a in aggregates])
        .withColumn("bucket", as_ms(F.col("bucket")))
    )
    if not fill:
        return counted
    first = start - (start - origin) % width
    number = max(0, -((first - end) // width))
    grid = _bucket_grid(rows.select(*keys).distinct() if keys else None, df, first, number, width)
    filled = join_null_safe(grid, counted, [*keys, "bucket"], "left")
    return filled.fillna(0, ["points"]) if "count" in aggregates else filled


def _bucket(df: DataFrame, time: str, width: int, origin: int):
    """The bucket of a row in the type of its time, and how to turn that into milliseconds.

    Timestamps are converted once per bucket, after counting.
    """
    kind = dict(df.dtypes)[time]
    if kind not in ("timestamp", "timestamp_ntz"):
        return bucket_start(F.col(time), width, origin), lambda c: c
    window = F.window(time, f"{width} milliseconds", startTime=f"{origin % width} milliseconds")
    return window["start"], epoch_ms if kind == "timestamp_ntz" else F.unix_millis


def _bucket_grid(devices: DataFrame | None, df, first: int, number: int, width: int) -> DataFrame:
    """All bucket starts, for each device if there are devices, in runs of bounded length."""
    bucket = (F.lit(first) + F.col("i").cast("bigint") * F.lit(width)).alias("bucket")
    if devices is None:
        return df.sparkSession.range(number).select(F.col("id").alias("i")).select(bucket)
    names = devices.columns
    if number == 0:
        return devices.select(*names, F.lit(0).cast("bigint").alias("bucket")).where(F.lit(False))
    run = F.expr(f"sequence(0L, {number - 1}L, {BUCKETS_PER_RUN}L)")
    stop = F.least(F.col("run") + BUCKETS_PER_RUN - 1, F.lit(number - 1))
    runs = devices.select(*names, F.explode(run).alias("run"))
    if number > BUCKETS_PER_RUN:
        runs = runs.repartition(*names, "run")
    return runs.select(*names, F.explode(F.sequence(F.col("run"), stop)).alias("i")).select(
        *names, bucket
    )


def range_scan_count(
    df: DataFrame,
    field: str,
    start=None,
    end=None,
    device=None,
    suffix: str | None = None,
    time: str = TIME,
    tag: str | None = TAG,
) -> DataFrame:
    """Rows of a device (by name or by name suffix) in a closed time range, from stored files."""
    rows = between(_of_device(df, device, tag), start, end, time)
    if suffix is not None:
        rows = rows.where(F.col(tag).cast("string").endswith(suffix))
    return rows.select(time, field).agg(F.count(F.lit(1)).alias("lines"))


def result_size(df: DataFrame) -> DataFrame:
    """Size of a query result: lines, points without the time column, cells, characters."""
    columns = len(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("lines"),
        (F.count(F.lit(1)) * (columns - 1)).alias("points"),
        (F.count(F.lit(1)) * columns).alias("cells"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("characters"),
    )


def keep_last(
    df: DataFrame, version: str, time: str = TIME, tag: str | None = TAG
) -> DataFrame:
    """One row per device and time: the one with the largest version."""
    keys = [time] if tag is None else [tag, time]
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(version, *[c for c in rest if c != version])
    latest = df.groupBy(*keys).agg(F.max(packed).alias("__row"))
    return latest.select(*keys, "__row.*").select(*df.columns)
