"""Network measurements: JSON lines with nested samples or clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..types import DOUBLE, MLAB_IP_FIELDS, MLAB_UTILIZATION_FIELDS, field
from .lines import read_lines

UTILIZATION = (
    "metric string, hostname string, experiment string, "
    "sample array<struct<timestamp: bigint, value: double>>"
)
# One schema for the three shapes of client files; each shape fills its own part.
CLIENT = "real_address: string, timestamp: bigint, connect_time: double"
DASH = f"client array<struct<{CLIENT}>>"
RAW = "client struct<myname: string, connect_time: double>, server struct<timestamp: bigint>"
FLAT = CLIENT.replace(":", "")


def _named(name: str, precisions: dict[str, int]):
    return field(name, DOUBLE, precisions[name]).metadata


def read_mlab_utilization(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample; the tag is ``metric.hostname,experiment``."""
    return utilization_records(read_lines(spark, path))


def utilization_records(lines: DataFrame) -> DataFrame:
    record = F.from_json("value", UTILIZATION).alias("r")
    part = {n: F.coalesce(f"r.{n}", F.lit("null")) for n in ("metric", "hostname", "experiment")}
    tag = F.concat(
        part["metric"], F.lit("."), part["hostname"], F.lit(","), part["experiment"]
    )
    return (
        lines.select(record)
        .select(tag.alias(TAG), F.explode("r.sample").alias("s"))
        .select(
            F.coalesce("s.timestamp", F.lit(0)).alias(TIME),
            TAG,
            F.coalesce("s.value", F.lit(0.0)).alias(
                "value", metadata=_named("value", MLAB_UTILIZATION_FIELDS)
            ),
        )
    )


def read_mlab_ip(spark: SparkSession, path: str) -> DataFrame:
    """``(time, deviceId = client address, connect_time)`` from three kinds of files.

    ``dash`` in the path: a list of clients per line; ``raw``: client and server parts;
    otherwise flat records.
    """
    lines = read_lines(spark, path)
    dash = F.col("file").contains("dash")
    raw = F.col("file").contains("raw")
    client = "array<struct<timestamp: bigint, real_address: string, connect_time: double>>"

    def record(time, address, connect):
        return F.struct(time.alias("timestamp"), address.alias("real_address"),
                        connect.alias("connect_time"))

    listed = F.transform(
        F.from_json("value", DASH)["client"],
        lambda c: record(c["timestamp"], c["real_address"], c["connect_time"]),
    )
    parts, flat = F.from_json("value", RAW), F.from_json("value", FLAT)
    nested = F.array(record(
        parts["server"]["timestamp"], parts["client"]["myname"], parts["client"]["connect_time"]
    ))
    single = F.array(record(flat["timestamp"], flat["real_address"], flat["connect_time"]))
    clients = F.when(dash, listed.cast(client)).when(raw, nested.cast(client)).otherwise(
        single.cast(client)
    )
    return (
        lines.select(F.explode(clients).alias("c"))
        .where(F.col("c.real_address").isNotNull())
        .select(
            F.coalesce("c.timestamp", F.lit(0)).alias(TIME),
            F.col("c.real_address").alias(TAG),
            F.coalesce("c.connect_time", F.lit(0.0)).alias(
                "connect_time", metadata=_named("connect_time", MLAB_IP_FIELDS)
            ),
        )
    )


def count_mlab_clients(spark: SparkSession, path: str) -> DataFrame:
    """Records per file: clients of ``dash`` files, lines of all others."""
    lines = read_lines(spark, path)
    clients = F.coalesce(F.size(F.from_json("value", DASH)["client"]), F.lit(0))
    number = F.when(F.col("file").contains("dash"), F.greatest(clients, F.lit(0))).otherwise(1)
    return lines.groupBy("file").agg(F.sum(number).alias("records"))
