"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions import epoch_ms

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a canonical table: the user is the device, time in milliseconds."""
    events = table(spark, sf_dir, "events")
    return events.select(
        epoch_ms(F.col("ts")).alias(TIME),
        F.concat(F.lit("root.u"), F.col("user_id").cast("string")).alias(TAG),
        "event_id", "event_type", "value", "props", "ts",
    )


# The same table in the checking SQL.
EVENT_POINTS = """
    select epoch_us(ts) // 1000 as "time", 'root.u' || user_id as "deviceId",
           event_id, event_type, value, props
    from events
"""
