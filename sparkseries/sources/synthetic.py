"""Generated tables, made in parallel from a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import TAG, TIME
from ..types import DOUBLE, SYNTHETIC_PRECISION, field, wide_schema

# Defaults of the generator.
SEED = 123456
DEVICES, SENSORS, POINTS = 100, 100, 10_000


def read_synthetic(
    spark: SparkSession,
    devices: int = DEVICES,
    points: int = POINTS,
    sensors: int = SENSORS,
    null_ratio: float = 0.0,
    seed: int = SEED,
) -> DataFrame:
    """``root.device_i`` with ``sensor_j`` in [0, 1) or null, times 0 to ``points - 1``."""
    columns = []
    for j in range(sensors):
        value = f"rand({seed + 2 * j})"
        if null_ratio > 0:
            value = f"case when rand({seed + 2 * j + 1}) >= {null_ratio!r}D then {value} end"
        columns.append(f"{value} as sensor_{j}")
    schema = wide_schema([
        field(f"sensor_{j}", DOUBLE, SYNTHETIC_PRECISION) for j in range(sensors)
    ])
    return spark.range(devices * points).selectExpr(
        f"pmod(id, {points}) as {TIME}",
        f"concat('root.device_', cast(id div {points} as string)) as {TAG}",
        *columns,
    ).to(schema)


def generate_wide(spark: SparkSession, rows: int, sensors: int, seed: int = SEED) -> DataFrame:
    """``rows`` records of one device with sensors ``s0 ..``, time = row number."""
    return spark.range(rows).selectExpr(
        f"id as {TIME}",
        f"'device' as {TAG}",
        *[f"rand({seed + j}) as s{j}" for j in range(sensors)],
    )
