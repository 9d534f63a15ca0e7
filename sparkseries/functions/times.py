"""Times: parsing, epoch arithmetic, buckets and predicate bounds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# The one text layout of times in CSV files, and plain epoch numbers.
ISO_PREFIX = "^\\d{4}-\\d{1,2}-\\d{1,2}T\\d{1,2}:\\d{1,2}:\\d{1,2}(\\.\\d{0,9})?"
OFFSET = "\\s*([+-]\\d{2}(:?\\d{2})?|Z)$"
INTEGER = "^[+-]?[0-9]+$"


def parse_time(text: Column, zone: str = "UTC", honour_offset: bool = True) -> Column:
    """Epoch milliseconds of ``yyyy-MM-dd'T'HH:mm:ss[.fraction][offset]`` or of an epoch number.

    A text without offset is read in ``zone``. ``honour_offset=False`` ignores
    whatever follows the seconds. Unreadable text gives null, as does a sign or ``Z`` that
    begins no offset.
    """
    local = F.concat(F.regexp_extract(text, ISO_PREFIX, 0), F.lit(" " + zone))
    if honour_offset:
        local = (
            F.when(text.rlike(ISO_PREFIX + OFFSET), text)
            .when(text.rlike(ISO_PREFIX + "\\s*([+-]|Z)"), F.lit(None))
            .otherwise(local)
        )
    iso = F.when(text.rlike(ISO_PREFIX), F.unix_millis(local.try_cast("timestamp")))
    return F.coalesce(iso, F.when(text.rlike(INTEGER), text.try_cast("bigint")))


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column, whatever the session zone is."""
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * F.lit(DAY_MS)
        + F.hour(ts).cast("bigint") * 3_600_000
        + F.minute(ts).cast("bigint") * 60_000
        + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
    )


def bucket_start(time: Column, width: int, origin: int = 0) -> Column:
    """Start of the bucket of ``width`` that holds an integer time; exact below zero as well."""
    shifted = time - F.lit(origin)
    return time - F.pmod(shifted, F.lit(width).cast("bigint"))


def seconds_to_ms(time: Column) -> Column:
    return time * F.lit(1000).cast("bigint")


def ms_to_ns(time: Column) -> Column:
    return time * F.lit(1_000_000).cast("bigint")


def time_bound(df: DataFrame, column: str, value) -> Column:
    """A literal of the column's own type, so that comparing with it reaches the file scan.

    ``value`` may be epoch milliseconds, a naive ``datetime`` (UTC) or an ISO text.
    """
    kind = dict(df.dtypes)[column]
    if kind not in ("timestamp", "timestamp_ntz"):
        return F.lit(value).cast(kind)
    if isinstance(value, int):
        value = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
    text = value.isoformat() if isinstance(value, dt.datetime) else value
    if kind == "timestamp":
        return F.lit(text + "+00:00").cast("timestamp")
    return F.lit(text).cast("timestamp_ntz")
