"""Wide and long layouts, point payload shapes and vertical splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions.sql import (
    any_present_sql,
    columns_sql,
    name_sql,
    present_cells_sql,
    texts_sql,
)
from .ranking import number_rows

# Sensors per table and points per payload batch.
MAX_FIELDS = 700
BATCH_POINTS = 1000
# Names that are spread without a pivot.
MAXIMA = 50


def sensor_columns(df: DataFrame, time: str = TIME, tag: str = TAG) -> list[str]:
    return [c for c in df.columns if c not in (time, tag)]


def any_present(fields: list[str]) -> Column:
    """True when at least one field is not null (NaN is a value)."""
    return F.expr(any_present_sql(fields))


def present_cells(fields: list[str]) -> Column:
    """Number of fields that are not null."""
    return F.expr(present_cells_sql(fields))


def null_skip(df: DataFrame, fields: list[str]) -> DataFrame:
    """Drop records without any field."""
    return df.where(any_present(fields))


def wide_to_long(
    df: DataFrame, fields: list[str] | None = None, time: str = TIME, tag: str = TAG
) -> DataFrame:
    """One row ``(deviceId, time, field, value)`` per present cell; fields share one type."""
    fields = fields or sensor_columns(df, time, tag)
    cells = F.expr("array(" + ", ".join(map(name_sql, fields)) + ")")
    long = df.select(tag, time, F.posexplode(cells).alias("__pos", "value"))
    name = F.expr(f"get({texts_sql(fields)}, __pos)").alias("field")
    return long.where(F.col("value").isNotNull()).select(tag, time, name, "value")


def wide_to_typed_long(
    df: DataFrame, fields: list[str] | None = None, time: str = TIME, tag: str = TAG
) -> DataFrame:
    """One row per present cell with the value in ``v_long``, ``v_double`` or ``v_text``."""
    fields = fields or sensor_columns(df, time, tag)
    kinds = {"v_long": "bigint", "v_double": "double", "v_text": "string"}
    slots = {"bigint": "v_long", "int": "v_long", "double": "v_double", "float": "v_double"}
    types = dict(df.dtypes)
    members = {v: [f for f in fields if slots.get(types[f], "v_text") == v] for v in kinds}
    # Cells of one type side by side; a cell is found by the type and its place in that array.
    arrays = [F.expr(columns_sql(members[v], kinds[v])).alias(f"__{v}") for v in kinds]
    ordered = [f for v in kinds for f in members[v]]
    start, parts = 0, []
    for v in kinds:
        parts.append(F.expr(f"get(__{v}, __pos - {start})").alias(v))
        start += len(members[v])
    numbers = F.expr(f"explode(sequence(0, {len(ordered) - 1}))").alias("__pos")
    cells = df.select(tag, time, *arrays).select("*", numbers)
    name = F.expr(f"get({texts_sql(ordered)}, __pos)").alias("field")
    return null_skip(cells.select(tag, time, name, *parts), list(kinds))


def spread(
    df: DataFrame, keys: list[str], name: str, names: list, value: str
) -> DataFrame:
    """One row per key and one column per listed name, holding the largest value.

    Few names are maxima of one aggregation, which shuffles once; many are a pivot, whose work per
    row does not grow with their number but which shuffles twice.
    """
    listed = df.where(F.col(name).isin(names))
    if len(names) <= MAXIMA:
        of = [F.max(F.when(F.col(name) == F.lit(n), F.col(value))).alias(f"__{i}") for i, n in enumerate(names)]
        return listed.groupBy(*keys).agg(*of).toDF(*keys, *[str(n) for n in names])
    wide = listed.groupBy(*keys).pivot(name, names).agg(F.max(value))
    return wide.toDF(*keys, *[str(n) for n in names])


def long_to_wide(
    df: DataFrame, fields: list[str], time: str = TIME, tag: str = TAG
) -> DataFrame:
    """Back to one row per device and time, with the listed fields as columns."""
    return spread(df, [tag, time], "field", fields, "value")


def points(long: DataFrame, time: str = TIME, tag: str = TAG) -> DataFrame:
    """``(name, tags, timestamp, value)`` rows of a long table."""
    return long.select(
        F.col("field").alias("name"),
        F.create_map(F.lit(TAG), F.col(tag).cast("string")).alias("tags"),
        F.col(time).alias("timestamp"),
        "value",
    )


def group_points(
    long: DataFrame,
    batch_points: int = BATCH_POINTS,
    time: str = TIME,
    tag: str = TAG,
) -> DataFrame:
    """Series cut into batches of at most ``batch_points`` points, each one array in time order."""
    numbered = number_rows(long.select(tag, "field", time, "value"), [tag, "field"], [time])
    batch = F.expr(f"(row_no - 1) div {int(batch_points)}").alias("batch")
    point = F.struct(F.col(time).alias("t"), F.col("value").alias("v"))
    return (
        numbered.select(tag, "field", batch, "row_no", point.alias("point"))
        .groupBy(tag, "field", "batch")
        .agg(F.sort_array(F.collect_list(F.struct("row_no", "point"))).alias("numbered"))
        .select(tag, "field", "batch", F.col("numbered.point").alias("datapoints"))
    )


def sparse_rows(
    df: DataFrame, fields: list[str] | None = None, time: str = TIME, tag: str = TAG
) -> DataFrame:
    """Per record the names, types and texts of its present fields; empty records are dropped."""
    fields = fields or sensor_columns(df, time, tag)
    types = dict(df.dtypes)
    cells = F.arrays_zip(
        F.expr(texts_sql(fields)).alias("name"),
        F.expr(texts_sql([types[f] for f in fields])).alias("type"),
        F.expr(columns_sql(fields, "string")).alias("value"),
    )
    records = null_skip(df, fields).select(tag, time, cells.alias("cells"))
    present = F.filter("cells", lambda c: c["value"].isNotNull())
    return records.select(tag, time, present.alias("cells")).select(
        tag,
        time,
        F.col("cells.name").alias("names"),
        F.col("cells.type").alias("types"),
        F.col("cells.value").alias("values"),
    )


def vertical_split(
    df: DataFrame,
    keys: list[str] | None = None,
    max_fields: int = MAX_FIELDS,
    name: str = "part",
) -> dict[str, DataFrame]:
    """Tables ``name_1 .. name_k`` of at most ``max_fields`` fields, each with the key columns."""
    keys = keys or [TIME, TAG]
    fields = [c for c in df.columns if c not in keys]
    chunks = [fields[i : i + max_fields] for i in range(0, len(fields), max_fields)]
    return {f"{name}_{i}": df.select(*keys, *chunk) for i, chunk in enumerate(chunks, 1)}


def rejoin(parts: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Undo :func:`vertical_split`; null is a key like others, and a key that repeats is an error.

    Each part is shuffled once. Tables with repeated keys are for
    :func:`~sparkseries.sinks.write_joined_parts`, which numbers their rows.
    """
    keys = keys or [TIME, TAG]
    fields = [c for part in parts.values() for c in part.columns if c not in keys]
    joined = reduce(
        lambda left, right: left.join(right, "__key"),
        [_keyed(part, keys, f"__{i}") for i, part in enumerate(parts.values())],
    )
    return joined.select(
        *[F.col("__key")[f"k{i}"].alias(k) for i, k in enumerate(keys)],
        *[
            F.col(f"__{i}")[f"v{j}"].alias(c)
            for i, part in enumerate(parts.values())
            for j, c in enumerate(c for c in part.columns if c not in keys)
        ],
    ).toDF(*keys, *fields)


def _keyed(part: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each key of a part, with its fields as one column; an error where a key repeats."""
    fields = [c for c in part.columns if c not in keys]
    values = [F.col(f"`{c}`").alias(f"v{j}") for j, c in enumerate(fields)] or [F.lit(0).alias("none")]
    message = F.concat(F.lit("a key repeats: "), F.to_json("__key"))
    return (
        part.groupBy(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("__key"))
        .agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*values)).alias(name))
        .where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(True))
        .drop("__n")
    )
