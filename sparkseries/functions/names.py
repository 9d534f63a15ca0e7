"""Device and field names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that may not stay in a name, and the part that is kept as it is.
SPECIAL_CHARACTERS = "[()@%\\-]"
REPLACEMENT = "a"
KEPT_PART = "root"


def normalize_name(name: Column) -> Column:
    """``root.T1.x-y`` -> ``root.aT1.axay``: no special characters, no part starting with a digit."""
    plain = F.regexp_replace(name, SPECIAL_CHARACTERS, REPLACEMENT)
    parts = F.split(F.regexp_replace(plain, "\\.+$", ""), "\\.")
    prefixed = F.transform(
        parts, lambda p: F.when(p == KEPT_PART, p).otherwise(F.concat(F.lit(REPLACEMENT), p))
    )
    return F.when(plain.rlike("^\\.+$"), F.lit("")).otherwise(F.concat_ws(".", prefixed))


def cut_position(series: Column) -> Column:
    """1-based position of the last dot of a series name, 0 when there is none."""
    return F.when(
        F.instr(series, ".") > 0,
        F.length(series) - F.length(F.substring_index(series, ".", -1)),
    ).otherwise(F.lit(0))


def device_part(series: Column, cut: Column) -> Column:
    """What stands before the cut; null when the name has no device in it."""
    return F.when(cut > 0, F.substring(series, F.lit(1), cut - 1))


def field_part(series: Column, cut: Column) -> Column:
    """What stands after the cut (the whole name for cut 0)."""
    return F.substring(series, cut + 1, F.length(series))
