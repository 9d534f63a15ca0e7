"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which also ends its lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def keep_decided(docs: DataFrame, id: str, digest: Column, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decided`` does not keep; of rows that repeat a key, one stays.

    The key of a row is ``digest`` and its id, in ``decided`` (``text_sha256, doc_id, kept``) as well.
    Only the repeated keys, if there are any, are compared with one another.
    """
    sha, key_id, key = fresh(docs, "sha"), fresh(docs, "kept_id"), fresh(docs, "kept_sha")
    keyed = docs.withColumn(sha, digest)
    same = (F.col(sha) == F.col(key)) & F.col(f"`{id}`").eqNullSafe(F.col(key_id))
    keys = decided.groupBy(F.col("text_sha256").alias(key), F.col("doc_id").alias(key_id)).agg(
        F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("n")
    )
    repeated = stored(keys.where("any_kept and n > 1").select(key, key_id), "repeats")
    out = [f"`{c}`" for c in docs.columns]
    if repeated.isEmpty():
        return keyed.join(keys.where("not any_kept").select(key, key_id), same, "left_anti").select(*out)
    rest = keyed.join(keys.where("not any_kept or n > 1").select(key, key_id), same, "left_anti")
    many = keyed.join(repeated, same, "left_semi").dropDuplicates([sha, id])
    return rest.select(*out).unionByName(many.select(*out))
