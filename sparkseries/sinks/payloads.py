"""Point payloads as text: one row, one message."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..functions import ms_to_ns, quote_text
from ..functions.sql import name_sql, text_sql
from ..operators.layout import (
    BATCH_POINTS,
    any_present,
    group_points,
    sensor_columns,
    sparse_rows,
    wide_to_typed_long,
)

# Measurement name of line messages.
MEASUREMENT = "tb1"
# Characters that a line message escapes, and how.
ESCAPED_IN_TEXT = '(["\\\\])'
ESCAPED_IN_TAG = "([,= ])"
ESCAPED_IN_NAME = "([, ])"
ESCAPE = "\\\\$1"


def json_text(text: Column) -> Column:
    """A text as a JSON string with its quotes."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _line_cell(name: str, kind: str) -> str:
    value = f"cast({name_sql(name)} as string)"
    if kind in ("double", "float"):  # a message has no NaN and no infinity
        value = f"if(isnan({name_sql(name)}) or abs({name_sql(name)}) = double('infinity'), null, {value})"
    if kind in ("bigint", "int"):
        value = f"{value}, 'i'"
    elif kind == "string":
        escaped = f"regexp_replace({value}, {text_sql(ESCAPED_IN_TEXT)}, {text_sql(ESCAPE)})"
        escaped = f"replace(replace({escaped}, '\\n', '\\\\n'), '\\r', '\\\\r')"
        value = f"'\"', {escaped}, '\"'"
    return f"concat({text_sql(_escaped_name(name) + '=')}, {value})"


def _escaped_name(name: str, signs: str = ESCAPED_IN_TAG) -> str:
    return re.sub(signs, r"\\\1", name).replace("\n", "\\n")


def line_protocol(
    df: DataFrame,
    fields: list[str] | None = None,
    measurement: str = MEASUREMENT,
    time: str = TIME,
    tag: str = TAG,
) -> DataFrame:
    """``measurement,deviceId=d f1=1i,f2=2.5,f3="x" time_ns`` for each record with a field.

    Names, tags and texts are escaped, line breaks as ``\\n``. NaN and infinite values are left out, as
    the format has none; a null or empty device has no tag.
    """
    fields = fields or sensor_columns(df, time, tag)
    types = dict(df.dtypes)
    cells = F.expr("concat_ws(',', " + ", ".join(_line_cell(f, types[f]) for f in fields) + ")")
    device = F.regexp_replace(F.col(tag).cast("string"), ESCAPED_IN_TAG, ESCAPE)
    device = F.replace(device, F.lit("\n"), F.lit("\\n"))
    head = F.concat_ws(
        f",{TAG}=", F.lit(_escaped_name(measurement, ESCAPED_IN_NAME)), F.nullif(device, F.lit(""))
    )
    rows = df.where(any_present(fields)).select(
        head.alias("head"), cells.alias("cells"), ms_to_ns(F.col(time)).cast("string").alias("at")
    )
    return rows.where("cells <> ''").select(F.concat_ws(" ", "head", "cells", "at").alias("value"))


def _finite(long: DataFrame) -> DataFrame:
    """Points without NaN and infinite values, which JSON does not have."""
    odd = F.col("v_double").isin(float("nan"), float("inf"), float("-inf"))
    return long.where(~F.coalesce(odd, F.lit(False)))


def _json_value() -> Column:
    """The present one of the three typed values; a text carries literal quotes."""
    number = F.coalesce(F.col("v_long").cast("string"), F.col("v_double").cast("string"))
    return F.coalesce(number, json_text(quote_text(F.col("v_text"))))


def _tags(tag: str) -> Column:
    return F.concat(F.lit(f'{{"{TAG}":'), json_text(F.col(tag).cast("string")), F.lit("}"))


def json_points(
    df: DataFrame,
    fields: list[str] | None = None,
    batched: bool = True,
    batch_points: int = BATCH_POINTS,
    time: str = TIME,
    tag: str = TAG,
) -> DataFrame:
    """JSON messages, one per point or one per batch of points of a series.

    NaN and infinite values are left out; a null device is a JSON null.
    """
    long = _finite(wide_to_typed_long(df, fields, time, tag)).select(
        tag, time, "field", _json_value().alias("value")
    )
    head = F.concat(
        F.lit('{"name":'), json_text(F.col("field")), F.lit(',"tags":'), _tags(tag)
    )
    if not batched:
        body = F.concat(
            head, F.lit(',"timestamp":'), F.col(time).cast("string"),
            F.lit(',"value":'), F.col("value"), F.lit("}"),
        )
        return long.select(body.alias("value"))
    pairs = F.transform(
        "datapoints", lambda p: F.concat(F.lit("["), p["t"].cast("string"), F.lit(","), p["v"], F.lit("]"))
    )
    body = F.concat(head, F.lit(',"datapoints":['), F.concat_ws(",", pairs), F.lit("]}"))
    return group_points(long, batch_points, time, tag).select(body.alias("value"))


def metric_points(
    df: DataFrame, fields: list[str] | None = None, time: str = TIME, tag: str = TAG
) -> DataFrame:
    """JSON messages ``metric, timestamp, value, tags``, one per point with a finite value."""
    long = _finite(wide_to_typed_long(df, fields, time, tag))
    body = F.concat(
        F.lit('{"metric":'), json_text(F.col("field")),
        F.lit(',"timestamp":'), F.col(time).cast("string"),
        F.lit(',"value":'), _json_value(),
        F.lit(',"tags":'), _tags(tag), F.lit("}"),
    )
    return long.select(body.alias("value"))


def record_payload(
    df: DataFrame, fields: list[str] | None = None, time: str = TIME, tag: str = TAG
) -> DataFrame:
    """One JSON message per record with the names, types and values of its present fields."""
    return sparse_rows(df, fields, time, tag).select(F.to_json(F.struct("*")).alias("value"))
