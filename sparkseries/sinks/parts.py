"""A wide table in parts that join again without a shuffle.

Every row gets an id when the table is written. All parts carry it and are bucketed and sorted by
it, in equally many buckets, so a merge join finds the fields of a row where they lie. Ids are
spread evenly whatever the keys are: repeated keys and null keys are rows like others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TAG, TIME
from ..operators.layout import MAX_FIELDS
from ..storage import new_path
from .tables import COMPRESSION

ROW_ID = "row_id"
META = "buckets int, keys array<string>, parts array<struct<name:string,schema:string>>"


def write_joined_parts(
    df: DataFrame, path: str, keys: list[str] | None = None, max_fields: int = MAX_FIELDS,
    buckets: int = 64, unique: bool = False,
) -> list[str]:
    """Write ``df`` as parts of at most ``max_fields`` fields below ``path``; the names of the parts.

    The input is computed once and shuffled once; the parts are cut from that copy. ``unique``
    refuses a table in which a key repeats. A column called ``row_id`` is refused.
    """
    keys = keys or [TIME, TAG]
    if ROW_ID in {c.lower() for c in df.columns}:
        raise ValueError(f"{ROW_ID} is a column of the parts")
    spark = df.sparkSession
    staged_at = new_path(spark, "staged")
    df.write.parquet(staged_at)
    staged = spark.read.schema(df.schema).parquet(staged_at)
    if unique:
        again = staged.groupBy(*[F.col(f"`{k}`") for k in keys]).count().where("count > 1").first()
        if again is not None:
            raise ValueError(f"a key repeats: {again.asDict()}")
    fields = [c for c in df.columns if c not in keys]
    chunks = [fields[i:i + max_fields] for i in range(0, len(fields), max_fields)] or [[]]
    names = [f"part_{i}" for i in range(1, len(chunks) + 1)]

    whole = f"rows_{uuid.uuid4().hex}"
    _write(
        staged.withColumn(ROW_ID, F.monotonically_increasing_id()).repartition(buckets, ROW_ID),
        whole, new_path(spark, "bucketed"), buckets,
    )
    # A task for each bucket of the copy, so that the parts keep its buckets without a shuffle.
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    parts = []
    try:
        for name, chunk in zip(names, chunks):
            part = spark.table(whole).select(ROW_ID, *[F.col(f"`{c}`") for c in [*keys, *chunk]])
            _write(part, f"{name}_{uuid.uuid4().hex}", f"{path}/{name}", buckets)
            parts.append((name, part.schema.json()))
    finally:
        spark.conf.set(key, before)
    spark.sql(f"DROP TABLE {whole}")
    spark.createDataFrame([(buckets, keys, parts)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return names


def _write(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    (
        rows.write.bucketBy(buckets, ROW_ID).sortBy(ROW_ID).mode("overwrite").format("parquet")
        .option("path", path).option("compression", COMPRESSION).saveAsTable(name)
    )


def read_joined_parts(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """The keys and the named fields (all by default); parts without one of them are not read.

    Buckets are those the parts were written with, as stored beside them.
    """
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    keys = list(meta["keys"])
    joined, have = None, []
    for name, schema in meta["parts"]:
        columns = T.StructType.fromJson(json.loads(schema))
        own = [c for c in columns.names if c not in (ROW_ID, *keys)]
        wanted = [c for c in own if fields is None or c in fields]
        if not wanted and (joined is not None or (name, schema) != tuple(meta["parts"][-1])):
            continue
        part = _open(spark, f"{path}/{name}", columns, meta["buckets"])
        have += wanted
        columns = [F.col(f"`{c}`") for c in wanted]
        if joined is None:
            joined = part.select(ROW_ID, *[F.col(f"`{k}`") for k in keys], *columns)
        else:
            joined = joined.join(part.select(ROW_ID, *columns).hint("merge"), ROW_ID)
    missing = set(fields or []) - set(have)
    if missing:
        raise ValueError(f"no part holds {sorted(missing)}")
    return joined.select(*[F.col(f"`{c}`") for c in [*keys, *(fields if fields is not None else have)]])


def _open(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    name = f"part_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({ROW_ID}) "
        f"SORTED BY ({ROW_ID}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
