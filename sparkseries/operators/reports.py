"""Load and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import BATCH_POINTS, present_cells, sensor_columns
from .ranking import first_rows, number_rows

# Batches in the moving average, and the marker of a finished query in a log.
LAST_BATCHES = 10_000
FINISHED_QUERY = "done! Query Param:(\\d+)\\."


def load_report(
    df: DataFrame,
    fields: list[str] | None = None,
    file: Column | None = None,
    batch_rows: int = BATCH_POINTS,
    elapsed_ms: float | None = None,
) -> DataFrame:
    """Files, records, points (all cells and present ones), batches and points per second.

    A batch never spans two files. Pre-aggregates per file, so the report itself
    sums one row per file.
    """
    fields = fields or sensor_columns(df)
    present = F.sum(present_cells(fields))
    by_file = df.groupBy((F.lit("") if file is None else file).alias("file")).agg(
        F.count(F.lit(1)).alias("records"), present.alias("present")
    )
    report = by_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.col("records") * len(fields)), F.lit(0)).alias("points"),
        F.coalesce(F.sum("present"), F.lit(0)).alias("present_points"),
        F.coalesce(F.sum(F.expr(f"(records + {batch_rows - 1}) div {batch_rows}")), F.lit(0))
        .alias("batches"),
    )
    if elapsed_ms is not None:
        report = report.withColumn("points_per_s", F.col("points") / F.lit(elapsed_ms / 1000.0))
    return report


def batch_latency(
    latencies: DataFrame,
    latency: str,
    order: list[str],
    last: int = LAST_BATCHES,
    scale: float = 1e6,
) -> DataFrame:
    """Mean latency over all batches and over the last ones (ns to ms by default)."""
    newest = first_rows(
        latencies.select(latency, *[c for c in order if c != latency]),
        [F.col(c).desc() for c in order], last,
    )
    mean = F.avg(F.col(latency) / F.lit(scale))
    over_all = latencies.agg(mean.alias("avg_all_ms"))
    over_last = newest.agg(mean.alias("avg_last_ms"), F.count(F.lit(1)).alias("n_last"))
    both = over_all.unionByName(over_last, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def query_latencies(lines: DataFrame, params: list[int] | None = None) -> DataFrame:
    """``(param, latency)`` of the log lines that report a finished query; other columns stay."""
    words = F.split(F.rtrim("value"), "\\s+")
    found = lines.where(F.col("value").rlike(FINISHED_QUERY)).select(
        *[c for c in lines.columns if c != "value"],
        F.regexp_extract("value", FINISHED_QUERY, 1).try_cast("bigint").alias("param"),
        F.try_element_at(words, F.lit(-2)).try_cast("double").alias("latency"),
    )
    if params is not None:
        found = found.where(F.col("param").isin(params))
    return found.where(F.col("param").isNotNull() & F.col("latency").isNotNull())


def latency_report(
    lines: DataFrame,
    order: list[str],
    params: list[int] | None = None,
    repeats: int | None = None,
) -> DataFrame:
    """Per query parameter the latency of each repeat in log order, and the mean of them all.

    A row ``(query_parameter, repeat, latency, average_ms)`` for each repeat, however many there
    are; or, if ``repeats`` is given, a row for each parameter with the first so many as columns.
    """
    found = query_latencies(lines, params)
    numbered = number_rows(found, ["param"], order, name="repeat")
    if repeats is None:
        means = found.groupBy("param").agg(F.avg("latency").alias("average_ms"))
        return numbered.join(means, "param").select(
            F.col("param").alias("query_parameter"), "repeat", "latency", "average_ms"
        )
    repeat = [
        F.max(F.when(F.col("repeat") == i, F.col("latency"))).alias(f"repeat{i}")
        for i in range(1, repeats + 1)
    ]
    return numbered.groupBy(F.col("param").alias("query_parameter")).agg(
        *repeat, F.avg("latency").alias("average_ms")
    )


def output_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and megabytes below a path, from file metadata; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("length")
    )
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        (F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1024.0 * 1024.0)).alias("megabytes"),
    )


def age_rollup(
    df: DataFrame, now: int, unit: int, time: str, by: list[str] | None = None
) -> DataFrame:
    """Counts over windows that double in length with age: 1, 2, 4, 8 .. units back from now."""
    age = F.expr(f"({int(now)} - `{time}`) div {int(unit)}")
    window = F.length(F.bin(age + 1)) - 1
    return (
        df.where(F.col(time) <= F.lit(now))
        .groupBy(*(by or []), window.alias("window"))
        .agg(F.count(F.lit(1)).alias("points"))
    )
