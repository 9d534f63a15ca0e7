"""Exact duplicates through a stored index of digests.

The index is a Parquet table bucketed and sorted by digest. New documents are reduced to one row
per digest, joined against the index by a sort-merge anti-join that leaves the index where it is,
and what the index lacks is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from .common import keep_decided, lower_ascii, stored, text_of


# Repeats of one row are given out in runs of so many.
COPIES_PER_RUN = 10_000
META = "buckets int, id_type string"


class DigestIndex:
    """A digest index at ``path``; an existing one is opened with the buckets it was made with.

    ``buckets`` and ``id_type``, the Spark type of the document ids, hold for a new index and are
    stored beside it. An existing one with another type of ids is refused.
    """

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"
    ) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not system.exists(place):
            spark.createDataFrame([(buckets, id_type)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        made = spark.read.schema(META).parquet(f"{path}/meta").first()
        if made.id_type != id_type:
            raise ValueError(f"the index at {path} holds ids of type {made.id_type}, not {id_type}")
        self.spark, self.buckets = spark, made.buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}) USING parquet CLUSTERED BY (digest) "
            f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/digests'"
        )

    def close(self) -> None:
        """Take the index out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add ``docs`` and return a row for each: what stays, and what it is a copy of.

        Texts are equal when identical after lower-casing A-Z; null counts as empty. A text that the
        index knows keeps its earlier document; of equal new texts the largest id stays. The row
        that the index keeps is kept again when it is given again, so a batch that is repeated, after
        a failure at any point, has the same result. Of rows that repeat both id and text one is
        kept. A null id stays only if its text has no other.
        ``group_size`` counts the equal texts among ``docs``. Other columns are not looked at; an
        empty table gives an empty result.
        """
        digest = F.unhex(F.sha2(lower_ascii(text_of(text)).cast("binary"), 256))
        rows = stored(
            docs.select(digest.alias("digest"), F.col(f"`{id}`").alias("id"))
            .groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n")),
            "digests",
        )
        groups = rows.groupBy("digest").agg(
            F.max("id").alias("top"), F.sum("n").alias("group_size")
        )
        known = self.table()
        new = groups.join(known.hint("merge"), "digest", "left_anti")
        found = groups.join(known.hint("merge"), "digest").select(
            "digest", "group_size", "keep_id", F.lit(False).alias("new")
        )
        groups = stored(
            found.union(new.select("digest", "group_size", "top", F.lit(True))), "groups"
        )
        (
            groups.where("new").select("digest", "keep_id")
            .repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        # Both sides are shuffled here, so that adaptive execution can split a large group.
        told = rows.join(groups, "digest").select(
            F.col("id").alias("doc_id"), "keep_id", "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), "n",
        )
        return _unfolded(told, rows)


def _unfolded(told: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` that repeat; the first of them is the one kept."""
    first = F.col("copy") == 0
    few = told.where(F.col("n") <= COPIES_PER_RUN).withColumn(
        "copy", F.explode(F.expr("sequence(0L, n - 1)"))
    )
    if not rows.where(F.col("n") > COPIES_PER_RUN).isEmpty():
        runs = told.where(F.col("n") > COPIES_PER_RUN).withColumn(
            "run", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES_PER_RUN}L)"))
        )
        many = runs.repartition(runs.sparkSession.sparkContext.defaultParallelism).withColumn(
            "copy", F.explode(F.expr(f"sequence(run, least(run + {COPIES_PER_RUN}L, n) - 1)"))
        )
        few = few.union(many.drop("run"))
    return few.withColumn("kept", F.col("kept") & first).drop("n", "copy")


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``, against a new index (see :meth:`DigestIndex.add`)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, new_path(spark, "index"), buckets, docs.schema[id].dataType.simpleString())
    return index.add(docs, id, text)


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns kept."""
    decided = stored(dedup(docs, id, text), "copies")
    digest = F.sha2(lower_ascii(text_of(text)).cast("binary"), 256)
    return keep_decided(docs, id, digest, decided)
