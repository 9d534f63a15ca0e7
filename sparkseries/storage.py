"""Where intermediate tables live, and joins whose small side has been measured."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows and bytes have been counted.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


_LOCAL: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkseries-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage, so that later uses read the same rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_measured(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a materialised lookup table, null keys to null keys; broadcast it only if it is measured to be small.

    ``small`` must be cheap to scan (the result of :func:`cut` or a stored table).
    Beyond the bound the join is left to Spark, whose adaptive execution splits
    skewed partitions.
    """
    size = small.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes"),
    ).first()
    if size["n"] <= BROADCAST_MAX_ROWS and (size["bytes"] or 0) <= BROADCAST_MAX_BYTES:
        small = F.broadcast(small)
    return join_null_safe(big, small, on, how)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the columns ``on`` come from the left."""
    names = {c: f"__right_{c}" for c in on}
    renamed = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    same = reduce(
        lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{names[c]}`")) for c in on]
    )
    return left.join(renamed, same, how).drop(*names.values())
