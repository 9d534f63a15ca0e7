"""Wide CSV files, each with a header of its own: time first, then one column per series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TAG, TIME
from ..functions import (
    cut_position,
    device_part,
    field_part,
    file_stem,
    infer_type_rank,
    missing,
    normalize_name,
    parse_time,
    safe_parse,
    strip_outer_quotes,
)
from ..functions.sql import parse_sql, texts_sql
from ..operators.layout import null_skip
from ..operators.schema import apply_catalog, merge_schemas, to_struct
from ..storage import cut, join_measured
from ..types import DEFAULT_PRECISION, NAME_OF, TEXT, wide_schema
from .lines import first_lines, head_lines, read_lines


@dataclass(frozen=True)
class CsvSeries:
    """How to read the files.

    ``sep`` is a regular expression. ``infer_rows`` limits type inference to the first
    rows of each file; by default all rows are looked at. ``normalize`` rewrites device
    and field names. ``zone`` applies to times without offset.
    """

    sep: str = ","
    infer_rows: int | None = None
    normalize: bool = True
    zone: str = "UTC"
    honour_offset: bool = True

    def cells(self, line: Column) -> Column:
        return F.split(line, self.sep)

    def values(self, line: Column) -> Column:
        """The cells without their quotes; a line without any quote is only split."""
        quoted = line.contains("'") | line.contains('"')
        cells = self.cells(line)
        return F.when(quoted, F.transform(cells, strip_outer_quotes)).otherwise(cells)

    def time(self, line: Column) -> Column:
        first = F.get(F.split(line, self.sep, 2), F.lit(0))
        return parse_time(first, self.zone, self.honour_offset)

    def name(self, text: Column) -> Column:
        return normalize_name(text) if self.normalize else text


def read_headers(lines: DataFrame, options: CsvSeries = CsvSeries()) -> DataFrame:
    """``(file, header, deviceId, names, series, fields)``: one row per file, arrays by column.

    The first series name decides about the device: what stands before its last dot, or
    the file name if it has no dot. Files without any series column are left out.
    """
    cells = options.cells(F.col("header"))
    last = F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i)))
    cut_at = cut_position(F.col("names")[0])
    device = F.coalesce(device_part(F.col("names")[0], F.col("cut_at")), file_stem(F.col("file")))
    headers = (
        first_lines(lines)
        .withColumn("names", F.slice(cells, F.lit(2), F.greatest(last, F.lit(0))))
        .where(F.size("names") > 0)
        .withColumn("cut_at", cut_at)
        .withColumn("device", device)
    )
    field = F.transform("names", lambda n: options.name(field_part(n, F.col("cut_at"))))
    series = F.when(F.col("cut_at") > 0, F.col("names")).otherwise(
        F.transform("names", lambda n: F.concat(F.col("device"), F.lit("."), n))
    )
    return cut(
        headers.select(
            "file",
            "header",
            options.name(F.col("device")).alias(TAG),
            "names",
            series.alias("series"),
            field.alias("fields"),
        )
    )


def _columns_of(headers: DataFrame) -> DataFrame:
    """One row ``(file, deviceId, pos, name, series, field)`` per series column of a file."""
    zipped = F.arrays_zip("names", "series", "fields")
    return headers.select("file", TAG, F.posexplode(zipped).alias("pos", "column")).select(
        "file",
        TAG,
        (F.col("pos") + 1).alias("pos"),
        F.col("column.names").alias("name"),
        F.col("column.series").alias("series"),
        F.col("column.fields").alias("field"),
    )


def infer_file_schemas(
    lines: DataFrame, headers: DataFrame, options: CsvSeries = CsvSeries()
) -> DataFrame:
    """``(file, deviceId, pos, series, field, type_rank, precision)`` from the cells themselves.

    Only one row per file and column leaves a task: cells are counted by type, and the
    header's own cell is subtracted later instead of joining headers to the lines.
    A column that is empty in a whole file keeps a null rank, the identity of merging.
    """
    whole = options.infer_rows is None
    if not whole:
        lines = head_lines(lines, options.infer_rows + 1).where(F.col("line_no") > 1)
    cells = lines.select(
        "file", F.posexplode(options.cells(F.col("value"))).alias("pos", "cell")
    ).select("file", "pos", infer_type_rank(F.col("cell")).alias("rank"))
    counted = (
        cells.where((F.col("pos") > 0) & F.col("rank").isNotNull())
        .groupBy("file", "pos")
        .agg(*[F.count_if(F.col("rank") == r).alias(f"n{r}") for r in NAME_OF])
    )
    own = infer_type_rank(F.col("name"))
    merged = F.greatest(*[
        F.when(F.col(f"n{r}") - F.when((own == r) & F.lit(whole), 1).otherwise(0) > 0, F.lit(r))
        for r in NAME_OF
    ])
    return (
        _columns_of(headers)
        .join(counted, ["file", "pos"], "left")
        .select(
            "file", TAG, "pos", "series", "field", merged.alias("type_rank"),
            F.lit(DEFAULT_PRECISION).alias("precision"),
        )
    )


def catalog_file_schemas(headers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Like :func:`infer_file_schemas`, with declared types; an undeclared series is an error."""
    columns = apply_catalog(_columns_of(headers), catalog)
    return columns.select(
        "file", TAG, "pos", "series", "field", "type_rank",
        F.lit(DEFAULT_PRECISION).alias("precision"),
    )


def _with_headers(lines: DataFrame, lookup: DataFrame) -> DataFrame:
    """Data lines with the columns of their file's ``lookup`` row."""
    joined = join_measured(lines, lookup, ["file"])
    return joined.where((F.col("block") > 0) | (F.col("value") != F.col("header")))


def _column_names(names: list[str]) -> list[str]:
    """Names of the sensor columns; one named like a key column gets underscores until it is free."""
    taken, out = {TIME, TAG, *names}, []
    for name in names:
        if name in (TIME, TAG):
            while name in taken:
                name += "_"
            taken.add(name)
        out.append(name)
    return out


def read_csv_series(
    spark: SparkSession,
    paths: str | list[str],
    options: CsvSeries = CsvSeries(),
    catalog: DataFrame | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """All files as one wide table under their merged schema.

    Types are inferred, taken from ``catalog``, or given by ``schema``. Rows whose time
    cannot be read are dropped; cells that do not fit their type are null. A series named
    like a key column is kept under that name with an underscore.
    """
    lines = read_lines(spark, paths)
    headers = read_headers(lines, options)
    if schema is None:
        columns = (
            infer_file_schemas(lines, headers, options)
            if catalog is None
            else catalog_file_schemas(headers, catalog)
        )
        merged = to_struct(merge_schemas(columns.select("field", "type_rank", "precision")))
        sensors = merged.fields[2:]
    else:
        sensors = [f for f in schema.fields if f.name not in (TIME, TAG)]
    # The last of several columns with one name wins, so names are looked up from the end.
    names = F.expr(texts_sql([f.name for f in sensors]))
    from_end = F.transform(names, lambda n: F.array_position(F.col("backward"), n))
    positions = F.transform(
        from_end, lambda p: F.when(p > 0, F.size("backward") - p.cast("int") + 1)
    )
    headers = headers.select("file", "header", TAG, F.reverse("fields").alias("backward"))
    lookup = cut(headers.select("file", "header", TAG, positions.alias("positions")))
    line = F.col("value")
    rows = _with_headers(lines, lookup).select(
        options.time(line).alias(TIME), TAG, "positions", options.values(line).alias("cells")
    )
    values = [
        parse_sql(f"get(cells, get(positions, {i}))", f.dataType.simpleString())
        + f" as __value_{i}"
        for i, f in enumerate(sensors)
    ]
    wide = rows.where(F.col(TIME).isNotNull()).selectExpr(TIME, TAG, *values)
    # Names may differ by case only, so columns are named last and by place.
    placed = [
        T.StructField(f"__value_{i}", f.dataType, f.nullable, f.metadata) for i, f in enumerate(sensors)
    ]
    return wide.to(wide_schema(placed)).toDF(TIME, TAG, *_column_names([f.name for f in sensors]))


def read_csv_points(
    spark: SparkSession,
    paths: str | list[str],
    options: CsvSeries = CsvSeries(),
    catalog: DataFrame | None = None,
    merged: bool = False,
) -> DataFrame:
    """All files in long form, whatever their headers are: one row per present cell.

    ``merged=False`` gives each file's column its own type, ``merged=True`` the type the
    field has over all files. The value is in ``v_long``, ``v_double`` or ``v_text``.
    """
    lines = read_lines(spark, paths)
    headers = read_headers(lines, options)
    columns = (
        infer_file_schemas(lines, headers, options)
        if catalog is None
        else catalog_file_schemas(headers, catalog)
    )
    if merged:
        types = merge_schemas(columns.select("field", "type_rank", "precision"))
        columns = columns.drop("type_rank").join(types.select("field", "type_rank"), "field")
    rank = F.coalesce("type_rank", F.lit(TEXT))
    described = F.sort_array(F.collect_list(F.struct("pos", "field", rank.alias("rank"))))
    lookup = cut(
        headers.select("file", "header", TAG).join(
            columns.groupBy("file").agg(described.alias("columns")), "file"
        )
    )
    line = F.col("value")
    rows = _with_headers(lines, lookup).select(
        options.time(line).alias(TIME), TAG, "columns", options.values(line).alias("cells")
    )
    cells = rows.where(F.col(TIME).isNotNull()).select(
        TIME, TAG, "cells", F.explode("columns").alias("column")
    ).select(
        TIME, TAG, "column.field", "column.rank", F.get("cells", F.col("column.pos")).alias("text")
    )
    typed = [
        F.when(F.col("rank") == r, safe_parse(F.col("text"), n)).alias(v)
        for (r, n), v in zip(NAME_OF.items(), ("v_long", "v_double", "v_text"))
    ]
    points = cells.where(F.col("text").isNotNull() & ~missing(F.col("text"))).select(
        TIME, TAG, "field", *typed
    )
    if catalog is None and options.infer_rows is None:
        # Every cell was seen when its type was inferred, so every cell fits.
        return points
    return null_skip(points, ["v_long", "v_double", "v_text"])
