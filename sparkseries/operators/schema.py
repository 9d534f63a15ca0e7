"""Type inference over cells, schema merging and applying a merged schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TAG, TIME
from ..functions import infer_type_rank
from ..types import DEFAULT_PRECISION, NAME_OF, RANK_OF, TEXT, field, wide_schema


def infer_types(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Merged type rank of raw text cells per group; null while every cell is empty."""
    return cells.groupBy(*by).agg(F.max(infer_type_rank(F.col(value))).alias("type_rank"))


def infer_column_types(df: DataFrame) -> DataFrame:
    """``(field, type_rank)`` of all columns of a table of texts, in one pass."""
    long = df.unpivot([], df.columns, "field", "value")
    return infer_types(long, ["field"])


def merge_schemas(*schemas: DataFrame) -> DataFrame:
    """Union of the field names with merged type rank and largest precision."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), schemas)
    if "precision" not in both.columns:
        both = both.withColumn("precision", F.lit(DEFAULT_PRECISION))
    return both.groupBy("field").agg(
        F.max("type_rank").alias("type_rank"),
        F.max(F.coalesce("precision", F.lit(DEFAULT_PRECISION))).alias("precision"),
    )


def with_type_name(schema: DataFrame) -> DataFrame:
    """Add the type name; a field that never held a value is text."""
    names = F.create_map(*[F.lit(x) for pair in NAME_OF.items() for x in pair])
    rank = F.coalesce("type_rank", F.lit(TEXT))
    return schema.withColumn("type", names[rank])


def to_struct(schema: DataFrame) -> T.StructType:
    """The merged schema as a Spark schema, fields in name order; a schema is driver data."""
    rows = schema.select("field", "type_rank", "precision").collect()
    return wide_schema(
        [field(r.field, r.type_rank or TEXT, r.precision) for r in sorted(rows)]
    )


# Types that others hold without loss.
WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def union_tables(*tables: DataFrame, time: str = TIME, tag: str = TAG) -> DataFrame:
    """Tables of different fields as one: absent fields are null, types are merged.

    Whole numbers, doubles and texts merge to the wider one. A field of another type, such as
    boolean or decimal, keeps it if all tables that have the field agree, and is an error if not.
    """
    kinds: dict[str, set[str]] = {}
    for table in tables:
        for name, kind in table.dtypes:
            if name not in (time, tag):
                kinds.setdefault(name, set()).add(WIDER.get(kind, kind))
    merged = {}
    for name, found in kinds.items():
        if found <= set(RANK_OF):
            merged[name] = NAME_OF[max(RANK_OF[kind] for kind in found)]
        elif len(found) == 1:
            merged[name] = found.pop()
        else:
            raise ValueError(f"no common type for {name}: {', '.join(sorted(found))}")
    cast = [
        t.select(*[
            F.col(c) if c in (time, tag) else F.col(f"`{c}`").cast(merged[c]).alias(c)
            for c in t.columns
        ])
        for t in tables
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; absent ones are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None))
        .cast(f.dataType).alias(f.name, metadata=f.metadata)
        for f in schema.fields
    ])


def apply_catalog(series: DataFrame, catalog: DataFrame, on: str = "series") -> DataFrame:
    """Add the declared type rank to series names; a series that is not declared is an error.

    Of several declarations of one series the last line holds.
    """
    line = F.monotonically_increasing_id().alias("__line")
    declared = catalog.select(on, "type_rank", line).groupBy(on).agg(
        F.max_by("type_rank", "__line").alias("type_rank")
    )
    message = F.concat(F.lit("no declared type for series "), F.col(on))
    checked = F.when(F.col("type_rank").isNull(), F.raise_error(message).cast("int")).otherwise(
        F.col("type_rank")
    )
    return series.join(declared, on, "left").withColumn("type_rank", checked)
