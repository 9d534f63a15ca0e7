"""Text files as lines that know their file and, if asked, their number in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decoded_path, plain_path
from ..storage import cut, join_measured


def read_lines(
    spark: SparkSession, paths: str | list[str], files: DataFrame | None = None
) -> DataFrame:
    """``(value, file, block)`` of all non-empty lines below the paths, in one scan.

    ``files``, as :func:`files_table` gives it, keeps the lines of its files only (hidden ones have none).
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(paths)
        .select(
            "value",
            decoded_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .where(F.col("value") != "")
    )
    if files is None:
        return lines
    wanted = cut(files.select(F.col("file").alias("__path")).distinct())
    kept = join_measured(lines.withColumn("__path", plain_path(F.col("file"))), wanted, ["__path"])
    return kept.drop("__path")


def number_lines(lines: DataFrame, keep: Column | None = None) -> DataFrame:
    """Add the 1-based ``line_no`` of every line in its file without sorting any lines.

    Rows of one block are consecutive in one task, so it is enough to know the first
    id and the row count of each block. Both come from one materialised scan, as another scan
    may cut its blocks elsewhere. ``keep`` leaves other lines out of the result; they count, but
    their text is not written.
    """
    tagged = lines.withColumn("__id", F.monotonically_increasing_id())
    if keep is not None:
        tagged = tagged.withColumn("__keep", F.coalesce(keep, F.lit(False)))
        others = [c for c in lines.columns if c not in ("file", "block")]
        tagged = tagged.withColumns({c: F.when(F.col("__keep"), F.col(f"`{c}`")) for c in others})
    tagged = cut(tagged)
    blocks = tagged.groupBy("file", "block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = cut(
        blocks.select(
            "file", "block", "__first",
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        )
    )
    line_no = F.col("__before") + F.col("__id") - F.col("__first") + 1
    if keep is not None:
        tagged = tagged.where("__keep")
    return join_measured(tagged, starts, ["file", "block"]).select(
        *lines.columns, line_no.alias("line_no")
    )


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every file with their ``line_no``; up to Spark's threshold for limits
    of groups (1000) a task sends on no more of a file."""
    order = Window.partitionBy("file").orderBy("block", "__id")
    return (
        lines.withColumn("__id", F.monotonically_increasing_id())
        .withColumn("line_no", F.row_number().over(order))
        .where(F.col("line_no") <= n).drop("__id")
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """``(file, header)``: the first line of every file; one row per file leaves a task."""
    tagged = lines.withColumn("__id", F.monotonically_increasing_id()).where(F.col("block") == 0)
    return tagged.groupBy("file").agg(F.min_by("value", "__id").alias("header"))
