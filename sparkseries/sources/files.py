"""File listings and the type catalog."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..storage import cut
from ..types import DECLARED_RANK, TEXT


def list_files(
    spark: SparkSession,
    path: str,
    begin: int = 0,
    end: int | None = None,
    suffix: str | None = None,
) -> list[str]:
    """Files below a folder in path order, numbers ``begin`` to ``end`` inclusive."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    files = sorted(reader.load(path).inputFiles())
    last = len(files) if end is None else end + 1
    return [unquote(f) for f in files[begin:last] if ".DS_Store" not in f]


def files_table(
    spark: SparkSession,
    path: str,
    begin: int = 0,
    end: int | None = None,
    suffix: str | None = None,
) -> DataFrame:
    """``(number, file, bytes)`` of the files below a folder, numbers ``begin`` to ``end`` inclusive.

    Tasks list the folders level by level, and the paths (absolute, without scheme) are numbered
    from 0 in path order in slices; none comes to the driver. Hidden files are listed too: they count,
    but those named ``.DS_Store`` are left out of the result. With ``suffix`` only files with it count.
    """
    uri = path if ":/" in path else os.path.abspath(path)
    system, root = FileSystem.from_uri(uri)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder in part["file"]:
                infos = system.get_file_info(FileSelector(folder))
                if infos:
                    yield pd.DataFrame({
                        "file": [i.path for i in infos],
                        "folder": [i.type == FileType.Directory for i in infos],
                        "bytes": [i.size or 0 for i in infos],
                    })

    shape = "file string, folder boolean, bytes long"
    info = system.get_file_info(root)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    level = spark.createDataFrame([(root, info.type == FileType.Directory, info.size or 0)], shape)
    levels = [level]
    tasks = spark.sparkContext.defaultParallelism
    while not (folders := level.where("folder")).isEmpty():
        level = cut(folders.repartition(tasks, "file").mapInPandas(listed, shape))
        levels.append(level)
    files = reduce(lambda a, b: a.union(b), levels).where("not folder").drop("folder")
    if suffix:
        files = files.where(F.col("file").endswith(suffix))
    number = (F.col("number") - 1).cast("bigint").alias("number")
    numbered = number_rows(files, [], ["file"], "number").select(number, "file", "bytes")
    if end is not None:
        numbered = numbered.where(F.col("number") <= end)
    return numbered.where((F.col("number") >= begin) & ~F.col("file").contains(".DS_Store"))


def read_type_catalog(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    series_column: int = 1,
    type_column: int = 4,
    header: bool = True,
) -> DataFrame:
    """``(series, type, type_rank)`` of a catalog file; undeclared types are text."""
    table = spark.read.option("sep", sep).option("header", header).csv(path)
    ranks = F.create_map(*[F.lit(x) for pair in DECLARED_RANK.items() for x in pair])
    return table.select(
        F.col(f"`{table.columns[series_column]}`").alias("series"),
        F.col(f"`{table.columns[type_column]}`").alias("type"),
    ).withColumn("type_rank", F.coalesce(F.try_element_at(ranks, F.col("type")), F.lit(TEXT)))
