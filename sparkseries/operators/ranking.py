"""Row numbers inside groups that may be of any size."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

# The final task of ORDER BY .. LIMIT n merges n rows of every other task.
TOP_N_ONE_TASK = 10_000
# Buckets of the first column in which a bound for a larger limit is looked for.
BOUND_BUCKETS = 4096
# A repeated row is numbered and unfolded in runs of at most this length.
COPIES_PER_RUN = 100_000


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str = "row_no"
) -> DataFrame:
    """1-based position of every row inside its group, exact whatever the group sizes are.

    Rows that tie on ``order`` are told apart by their remaining columns. Equal rows are folded into
    runs, the runs are cut by range into slices, and every slice is counted and sorted by itself.
    """
    return _number_slices(df, keys, total_order(df, keys, order), name)


def total_order(df: DataFrame, keys: list[str], order: list[Column | str]) -> list[Column]:
    """``order`` followed by the columns that are not in it yet."""
    named = {c for c in order if isinstance(c, str)} | set(keys)
    first = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return (first + rest) or [F.lit(0)]


def _number_slices(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    by_key = [F.col(f"`{k}`") for k in keys]
    ties = [F.col(f"`{c}`") for c in df.columns]
    # Equal rows become runs with a count, so no value can fill a slice by itself.
    # Grouping does not tell -0.0 from 0.0, so the sign is a key of its own.
    zeros = [c for c, kind in df.dtypes if kind in ("double", "float")]
    signs = {c: F.col(f"`{c}`").cast("string") == "-0.0" for c in zeros}
    folded = df.groupBy(*ties, *[s.alias(f"__sign_{c}") for c, s in signs.items()]).agg(
        F.count(F.lit(1)).alias("__all")
    )
    signed = [
        F.when(F.col(f"`__sign_{c}`"), F.lit(-0.0).cast(kind)).otherwise(F.col(f"`{c}`")).alias(c)
        if c in signs else F.col(f"`{c}`")
        for c, kind in df.dtypes
    ]
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("__all") - 1, F.lit(COPIES_PER_RUN).cast("bigint"))
    runs = folded.select(*signed, "__all", F.explode(starts).alias("__run")).select(
        *ties, "__run", F.least(F.lit(COPIES_PER_RUN), F.col("__all") - F.col("__run")).alias("__copies")
    )
    sliced = cut(
        runs.repartitionByRange(*by_key, *order, "__run")
        .withColumn("__slice", F.spark_partition_id())
        .withColumn("__key", F.struct(F.lit(0), *by_key))
    )
    # One row per slice and group: few, so a window can add up the slices of a group.
    earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy("__slice", "__key")
        .agg(F.sum("__copies").alias("__n"))
        .select(
            "__slice", "__key", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
        )
    )
    upto = Window.partitionBy("__slice", "__key").orderBy(*order, "__run").rowsBetween(
        Window.unboundedPreceding, 0
    )
    last = F.col("__before") + F.col("__upto")
    return (
        sliced.withColumn("__upto", F.sum("__copies").over(upto))
        .join(offsets, ["__slice", "__key"])
        .select(*ties, F.explode(F.sequence(last - F.col("__copies") + 1, last)).alias(name))
    )


def _as_long(column: str, kind: str) -> Column | None:
    """A whole number in the order of ``column``, if its type has one."""
    value = F.col(f"`{column}`")
    if kind in ("bigint", "int"):
        return value.cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(value)
    if kind == "timestamp_ntz":
        since = (value - F.expr("timestamp_ntz'1970-01-01'")).cast("interval second")
        return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return None


def _literal(number: int, kind: str) -> Column:
    """The value that :func:`_as_long` turns into ``number``; a constant that reaches the scan."""
    if kind == "timestamp":
        return F.expr(f"timestamp_micros({number}L)")
    if kind == "timestamp_ntz":
        moment = datetime(1970, 1, 1) + timedelta(microseconds=number)
        return F.expr(f"timestamp_ntz'{moment.isoformat(' ')}'")
    return F.lit(number).cast(kind)


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order, through one task only while ``n`` is small.

    For more rows, counts by bucket of the first column, refined where the limit falls, tell the
    value up to which rows are taken; rows that tie there are numbered in slices. The result is
    sorted by range.
    """
    total = total_order(df, [], order)
    if n <= TOP_N_ONE_TASK:
        return df.orderBy(*total).limit(n)
    column = order[0] if isinstance(order[0], str) else None
    kind = dict(df.dtypes).get(column)
    place = _as_long(column, kind) if column else None
    if place is None:
        return _numbered_first(df, order, n).orderBy(*total)
    value = F.col(f"`{column}`")
    rows, nulls, low, high = df.agg(
        F.count(F.lit(1)), F.count_if(value.isNull()), F.min(place), F.max(place)
    ).first()
    if rows <= n:
        return df.orderBy(*total)
    if low is None or high - low >= 1 << 62:
        return _numbered_first(df, order, n).orderBy(*total)
    if nulls >= n:  # nulls come first
        return _numbered_first(df.where(value.isNull()), order, n).orderBy(*total)
    before, count = nulls, rows - nulls
    while count > TOP_N_ONE_TASK and high > low:
        width = -(-(high - low + 1) // BOUND_BUCKETS)
        inside = df.where((value >= _literal(low, kind)) & (value <= _literal(high, kind)))
        bucket = F.call_function("div", place - F.lit(low).cast("bigint"), F.lit(width).cast("bigint"))
        counts = inside.groupBy(bucket.alias("bucket")).count().collect()  # at most BOUND_BUCKETS
        for at, count in sorted(map(tuple, counts)):
            if before + count >= n:
                break
            before += count
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    edge = df.where((value >= _literal(low, kind)) & (value <= _literal(high, kind)))
    if count <= TOP_N_ONE_TASK:
        edge = edge.orderBy(*total).limit(n - before)
    else:
        edge = _numbered_first(edge, order, n - before)
    return df.where(value.isNull() | (value < _literal(low, kind))).union(edge).orderBy(*total)


def _numbered_first(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    numbered = number_rows(df, [], order, name="__row_no")
    return numbered.where(F.col("__row_no") <= n).drop("__row_no")


def first_rows_per_group(
    df: DataFrame, keys: list[str], order: list[Column | str], n: int
) -> DataFrame:
    """The first ``n`` rows of every group.

    Up to Spark's group-limit threshold every task keeps only ``n`` rows of a group
    before the shuffle, so large groups need no further care.
    """
    conf = df.sparkSession.conf
    if n <= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        window = Window.partitionBy(*keys).orderBy(*total_order(df, keys, order))
        numbered = df.withColumn("__row_no", F.row_number().over(window))
    else:
        numbered = number_rows(df, keys, order, name="__row_no")
    return numbered.where(F.col("__row_no") <= n).drop("__row_no")
