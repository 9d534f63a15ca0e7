"""Moving means over a whole log, and windows that double in length with age and are kept up by loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import number_rows
from .reports import LAST_BATCHES

# Levels of age windows: the longest holds two to this power units.
MOST_LEVEL = 40


def moving_mean(
    df: DataFrame, value: str, order: list[str], last: int = LAST_BATCHES, keys: list[str] | None = None
) -> DataFrame:
    """At every row the mean of ``value`` over the ``last`` rows up to it: ``row_no, mean, n``.

    Rows are numbered in slices and dealt into runs of ``last`` rows. Each run is given the run
    before it as well, so a window inside a run sees all it needs: no task holds more than two
    runs, whatever the length of the log. Null values count as rows and not in the mean or in ``n``.
    """
    keys = keys or []
    ids = [F.col(f"`{k}`") for k in keys]
    numbered = number_rows(df, keys, order)
    run = F.expr(f"(row_no - 1) div {int(last)}")
    dealt = numbered.withColumn("__own", run).withColumn(
        "__run", F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )
    window = Window.partitionBy(*ids, "__run").orderBy("row_no").rowsBetween(1 - int(last), 0)
    return (
        dealt.withColumn("mean", F.avg(f"`{value}`").over(window))
        .withColumn("n", F.count(f"`{value}`").over(window))
        .where("__run = __own").drop("__own", "__run")
    )


def age_level(start: str, now: Column | int) -> Column:
    """The level of the age window that holds the unit ``start`` when ``now`` is the newest unit.

    A window of level k spans 2**k units, aligned with them, and its end is at least as old as it is
    long. Windows of one level merge into the next as time goes on and are never split.
    """
    now_sql = f"{int(now)}L" if isinstance(now, int) else now
    return F.expr(
        f"coalesce(array_max(filter(sequence(0, {MOST_LEVEL}), k -> "
        f"{now_sql} + 1 - (shiftright({start}, k) + 1) * shiftleft(1L, k) >= shiftleft(1L, k))), 0)"
    )


def _levelled(windows: DataFrame, keys: list[str], now: int) -> DataFrame:
    """Windows ``(*keys, start, points)`` merged to what they are at ``now``."""
    levelled = windows.withColumn("level", age_level("start", now))
    start = F.expr("shiftleft(shiftright(start, level), level)")
    return (
        levelled.withColumn("start", start).groupBy(*keys, "start", "level")
        .agg(F.sum("points").alias("points"))
    )


def update_age_windows(
    df: DataFrame, path: str, load: str, unit: int, time: str, field: str | None = None,
    keys: list[str] | None = None,
) -> bool:
    """Add the rows of a load to the age windows at ``path``; false if that load is in them.

    Reads the windows and the new rows, never the rows of earlier loads: there are about two
    windows for each doubling of age and key. Times may come in any order; late rows go to the window
    that holds their time now. Rows without a time are left out. A new version is written beside the last
    one and takes its place by its last step, so a load that failed is done again.
    """
    spark, keys = df.sparkSession, keys or []
    version = _version(spark, path)
    loads = list(version["loads"]) if version else []
    if load in loads:
        return False
    points = F.count(F.lit(1)) if field is None else F.count(f"`{field}`")
    number = (version["version"] if version else 0) + 1
    into = f"{path}/version={number}"
    unit_of = F.expr(f"floor(`{time}` / {int(unit)})").cast("bigint")
    fresh = (
        df.where(F.col(time).isNotNull()).groupBy(*keys, unit_of.alias("start"))
        .agg(points.cast("bigint").alias("points"))
    )
    fresh.write.mode("overwrite").parquet(f"{into}/fresh")
    fresh = spark.read.schema(fresh.schema).parquet(f"{into}/fresh")
    newest = fresh.agg(F.max("start")).first()[0]
    nows = [n for n in (newest, version["now"] if version else None) if n is not None]
    now = max(nows) if nows else None
    known = fresh
    if version:
        known = known.union(spark.read.parquet(version["windows"]).select(*fresh.columns))
    windows = _levelled(known, keys, now if now is not None else 0)
    windows.write.mode("overwrite").parquet(f"{into}/windows")
    done = (number, now, int(unit), [*loads, load], f"{into}/windows")
    spark.createDataFrame([done], VERSION).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return True


VERSION = "version bigint, now bigint, unit bigint, loads array<string>, windows string"


def _version(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    return spark.read.schema(VERSION).parquet(f"{path}/versions").orderBy(F.desc("version")).first()


def age_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows now: keys, ``start`` and ``until`` in time (``until`` excluded), ``level``, ``points``."""
    version = _version(spark, path)
    if version is None:
        raise ValueError(f"{path} holds no age windows")
    unit = F.lit(version["unit"])
    windows = spark.read.parquet(version["windows"])
    return windows.withColumn("until", (F.col("start") + F.expr("shiftleft(1L, level)")) * unit).withColumn(
        "start", F.col("start") * unit
    )


def count_age_windows(
    spark: SparkSession, path: str, start: int, end: int, keys: list[str] | None = None
) -> DataFrame:
    """Points from ``start`` to before ``end``: ``least, estimate, most`` for each of ``keys``.

    Windows inside the range are counted as they are; of those at its ends nothing is in
    ``least`` and all is in ``most``, and the estimate takes their points as evenly spread. The
    count of the rows lies between ``least`` and ``most``, which differ by at most two windows.
    """
    keys = keys or []
    windows = age_windows(spark, path).where((F.col("start") < end) & (F.col("until") > start))
    inside = (F.col("start") >= start) & (F.col("until") <= end)
    shared = F.least("until", F.lit(end)) - F.greatest("start", F.lit(start))
    share = F.col("points") * shared / (F.col("until") - F.col("start"))
    return windows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(inside, F.col("points"))), F.lit(0)).alias("least"),
        F.coalesce(F.sum(F.when(inside, F.col("points").cast("double")).otherwise(share)), F.lit(0.0)).alias("estimate"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("most"),
    )
