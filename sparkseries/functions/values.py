"""Cell values: type inference, quoting and parsing without errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DOUBLE, LONG, RANK_OF, TEXT
from .times import INTEGER

# How a double may be written; any other text is not a number.
DOUBLE_SHAPE = (
    "^\\s*[+-]?("
    "NaN|Infinity"
    "|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?"
    "|0[xX]([0-9a-fA-F]+\\.?|[0-9a-fA-F]*\\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[dDfF]?"
    ")\\s*$"
)


def missing(text: Column) -> Column:
    """An empty cell, or the word null."""
    return (text == "") | (F.lower(text) == "null")


def _as_long(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def _as_double(text: Column) -> Column:
    # The shape is tested first: a failing cast costs far more than a failing match.
    return F.when(text.rlike(DOUBLE_SHAPE), text.try_cast("double"))


def infer_type_rank(text: Column) -> Column:
    """Rank of the narrowest type a raw cell fits; null for an empty cell or ``null``.

    Quotes are not removed, so a quoted number is text.
    """
    return (
        F.when(text.isNull() | missing(text), F.lit(None).cast("int"))
        .when(_as_long(text).isNotNull(), F.lit(LONG))
        .when(text.rlike(DOUBLE_SHAPE), F.lit(DOUBLE))
        .otherwise(F.lit(TEXT))
    )


def strip_outer_quotes(text: Column) -> Column:
    """Remove one matching pair of single or double quotes."""
    first = F.left(text, F.lit(1))
    quoted = (F.length(text) >= 2) & first.isin("'", '"') & (first == F.right(text, F.lit(1)))
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def safe_parse(text: Column, type_name: str) -> Column:
    """A cell as ``bigint``, ``double`` or ``string``; null when empty, ``null`` or not of the type."""
    rank = RANK_OF[type_name]
    if rank == TEXT:
        return F.when(~missing(text), text)
    # No empty cell and no "null" reads as a number.
    return _as_long(text) if rank == LONG else _as_double(text)


def pad_row(cells: Column, width: int) -> Column:
    """A row of cells with nulls where it is shorter than the schema."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(cells, i))


def quote_text(text: Column) -> Column:
    """Text value of a point payload."""
    return F.concat(F.lit('"'), text, F.lit('"'))


def sql_escape_text(text: Column) -> Column:
    """Text value of an INSERT: inner single quotes become double, outer ones are added."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit('"')), F.lit("'"))


def sql_identifier(name: str) -> str:
    return f'"{name}"'
