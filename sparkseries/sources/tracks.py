"""Sources with a fixed schema: trajectories, weather records and meter readings.

``path`` is the data folder, which device names are relative to; ``files`` restricts
the reader to some of the files below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions import parent_of, relative_path, seconds_to_ms
from ..functions.times import INTEGER
from ..types import (
    GEOLIFE_FIELDS,
    NOAA_FIELDS,
    REDD_FIELDS,
    TDRIVE_FIELDS,
    double_schema,
)
from .lines import read_lines

# Prefix of device names, and the shift that makes all record times positive.
DEVICE_PREFIX = "root.group_0.d_"
NOAA_SHIFT_MS = 2_209_046_400_000

# 0-based first and end columns of a fixed-width weather record.
NOAA_COLUMNS = {
    "TEMP": (24, 30),
    "DEWP": (35, 41),
    "SLP": (46, 52),
    "STP": (57, 63),
    "VISIB": (68, 73),
    "WDSP": (78, 83),
    "MXSPD": (88, 93),
    "GUST": (95, 100),
    "MAX": (102, 108),
    "MIN": (110, 116),
    "PRCP": (118, 123),
    "SNDP": (125, 130),
    "FRSHTT": (132, 138),
}
NOAA_STATION, NOAA_WBAN, NOAA_DATE = (0, 6), (7, 12), (14, 22)
# What stands in a weather record for a missing measurement.
NOAA_SENTINELS = [9999.9, 999.9, 99.99]

HALF_DAY_MS = 43_200_000


def _moment(text: Column, zone: str, twelve_hours: bool) -> Column:
    """Epoch ms of ``yyyy-MM-dd HH:mm:ss``; ``twelve_hours`` reads hour 12 as hour 0."""
    shape = "^\\d{4}-\\d{1,2}-\\d{1,2} (\\d{1,2}):\\d{1,2}:\\d{1,2}"
    local = F.concat(F.regexp_extract(text, shape, 0), F.lit(" " + zone))
    ms = F.unix_millis(local.try_cast("timestamp"))
    if twelve_hours:
        noon = F.regexp_extract(text, shape, 1) == "12"
        ms = F.when(noon, ms - HALF_DAY_MS).otherwise(ms)
    return F.when(text.rlike(shape), ms)


def _records(rows: DataFrame, time: Column, device: Column, values: dict[str, Column],
             precisions: dict[str, int]) -> DataFrame:
    """The canonical wide table; a record with an unreadable time or value is dropped."""
    record = F.struct(time.alias(TIME), device.alias(TAG), *[v.alias(n) for n, v in values.items()])
    # A generator keeps the filter above it, so that every value is parsed once.
    table = rows.select(F.inline(F.array(record)))
    for name in [TIME, *values]:
        table = table.where(F.col(name).isNotNull())
    return table.to(double_schema(precisions))


def _root(spark: SparkSession, path: str) -> str:
    """The absolute path of a folder, without scheme."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return folder.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().getPath()


def read_geolife(
    spark: SparkSession,
    path: str,
    zone: str = "UTC",
    twelve_hours: bool = False,
    files: list[str] | None = None,
) -> DataFrame:
    """GPS tracks ``lat,lon,0,altitude,days,date,time``; the device is the folder of the track.

    The six header lines of a file hold no date in column six, so they are dropped
    like any other line that is not a record.
    """
    lines = read_lines(spark, files or path)
    items = F.col("items")
    rows = lines.select("file", F.split("value", ",").alias("items"))
    moment = F.concat(F.get(items, F.lit(5)), F.lit(" "), F.get(items, F.lit(6)))
    device = parent_of(relative_path(F.col("file"), _root(spark, path)), "Trajectory")
    values = {
        n: F.get(items, F.lit(i)).try_cast("double") for i, n in enumerate(GEOLIFE_FIELDS)
    }
    return _records(
        rows, _moment(moment, zone, twelve_hours), F.concat(F.lit(DEVICE_PREFIX), device),
        values, GEOLIFE_FIELDS,
    )


def read_noaa(
    spark: SparkSession,
    path: str,
    device_from: str = "file",
    sentinel_to_null: bool = False,
    files: list[str] | None = None,
) -> DataFrame:
    """Daily weather records of fixed width; the header line is not a record and drops out.

    The device is station and WBAN number, from the file name or (``line``) from the record.
    """
    def part(span):
        return F.trim(F.substring("value", span[0] + 1, span[1] - span[0]))

    lines = read_lines(spark, files or path)
    day = part(NOAA_DATE)
    iso = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    days = F.when(day.rlike("^\\d{8}$"), F.unix_date(iso.try_cast("date")))
    time = days.cast("bigint") * 86_400_000 + F.lit(NOAA_SHIFT_MS)
    if device_from == "file":
        name = F.split(
            F.replace(relative_path(F.col("file"), _root(spark, path)), F.lit(".op"), F.lit("")), "-"
        )
        device = F.concat_ws("_", F.get(name, F.lit(0)), F.get(name, F.lit(1)))
    else:
        device = F.concat_ws("_", part(NOAA_STATION), part(NOAA_WBAN))
    values = {n: part(span).try_cast("double") for n, span in NOAA_COLUMNS.items()}
    table = _records(lines, time, F.concat(F.lit(DEVICE_PREFIX), device), values, NOAA_FIELDS)
    if not sentinel_to_null:
        return table
    return table.select(TIME, TAG, *[
        F.when(~F.col(n).isin(NOAA_SENTINELS), F.col(n)).alias(n) for n in NOAA_FIELDS
    ])


def read_tdrive(
    spark: SparkSession,
    path: str,
    zone: str = "UTC",
    twelve_hours: bool = False,
    device_from: str = "file",
    files: list[str] | None = None,
) -> DataFrame:
    """Taxi positions ``id,time,lon,lat`` without header; device from file name or column ``id``."""
    items = F.col("items")
    rows = read_lines(spark, files or path).select("file", F.split("value", ",").alias("items"))
    if device_from == "file":
        device = F.replace(relative_path(F.col("file"), _root(spark, path)), F.lit(".txt"), F.lit(""))
    else:
        device = F.get(items, F.lit(0))
    values = {
        n: F.get(items, F.lit(i + 2)).try_cast("double") for i, n in enumerate(TDRIVE_FIELDS)
    }
    return _records(
        rows, _moment(F.get(items, F.lit(1)), zone, twelve_hours),
        F.concat(F.lit(DEVICE_PREFIX), device), values, TDRIVE_FIELDS,
    )


def read_redd(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Meter readings ``epoch_seconds value``; the device is the file path in one word."""
    items = F.col("items")
    rows = read_lines(spark, files or path).select("file", F.split("value", " ").alias("items"))
    seconds = F.get(items, F.lit(0))
    time = F.when(seconds.rlike(INTEGER), seconds_to_ms(seconds.try_cast("bigint")))
    name = F.replace(relative_path(F.col("file"), _root(spark, path)), F.lit(".dat"), F.lit(""))
    device = F.concat(F.lit(DEVICE_PREFIX), F.replace(name, F.lit("/"), F.lit("_")))
    values = {"value": F.get(items, F.lit(1)).try_cast("double")}
    return _records(rows, time, device, values, REDD_FIELDS)
