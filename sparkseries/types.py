"""The three value types, their merge order and the fixed schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from . import TAG, TIME

# Merging two types is taking the larger rank: text wins over numbers, double over long.
LONG, DOUBLE, TEXT = 1, 2, 3
RANK_OF = {"bigint": LONG, "double": DOUBLE, "string": TEXT}
NAME_OF = {rank: name for name, rank in RANK_OF.items()}
TYPE_OF = {LONG: T.LongType(), DOUBLE: T.DoubleType(), TEXT: T.StringType()}

# Precision given to fields whose type is inferred.
DEFAULT_PRECISION = 8

# Types a catalog may declare; anything else is text.
DECLARED_RANK = {
    "FLOAT": DOUBLE,
    "DOUBLE": DOUBLE,
    "INT32": LONG,
    "INT64": LONG,
    "BOOLEAN": TEXT,
    "TEXT": TEXT,
}

# Fields and precisions of the datasets with a fixed schema.
GEOLIFE_FIELDS = {"Latitude": 6, "Longitude": 6, "Zero": 0, "Altitude": 0}
NOAA_FIELDS = {
    "TEMP": 1, "DEWP": 1, "SLP": 1, "STP": 1, "VISIB": 1, "WDSP": 1, "MXSPD": 1,
    "GUST": 1, "MAX": 1, "MIN": 1, "PRCP": 2, "SNDP": 1, "FRSHTT": 0,
}
TDRIVE_FIELDS = {"longitude": 5, "latitude": 5}
REDD_FIELDS = {"value": 2}
MLAB_UTILIZATION_FIELDS = {"value": 10}
MLAB_IP_FIELDS = {"connect_time": 6}
SYNTHETIC_PRECISION = 4


def merge_type(left: int | None, right: int | None) -> int | None:
    """Driver-side twin of the ``max`` that merges types; unknown is the identity."""
    known = [rank for rank in (left, right) if rank is not None]
    return max(known) if known else None


def field(name: str, rank: int, precision: int = DEFAULT_PRECISION) -> T.StructField:
    return T.StructField(name, TYPE_OF[rank], True, {"precision": precision})


def wide_schema(fields: list[T.StructField]) -> T.StructType:
    keys = [T.StructField(TIME, T.LongType()), T.StructField(TAG, T.StringType())]
    return T.StructType(keys + list(fields))


def double_schema(precisions: dict[str, int]) -> T.StructType:
    return wide_schema([field(name, DOUBLE, p) for name, p in precisions.items()])


def same_schema(left: T.StructType, right: T.StructType) -> bool:
    """Equal names, types and precisions, in order."""
    def key(schema):
        return [(f.name, f.dataType, f.metadata.get("precision")) for f in schema.fields]

    return key(left) == key(right)


def position_of(schema: T.StructType, name: str) -> int:
    """Position of a field, -1 when it is absent."""
    names = schema.fieldNames()
    return names.index(name) if name in names else -1
