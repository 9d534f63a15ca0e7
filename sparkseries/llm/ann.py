"""Nearest vectors by cross-polytope hashing.

Each table turns unit vectors by three rounds of random signs and a fast Hadamard transform and assigns
them to the nearest signed axis, the coordinate of the largest size with its sign. A query looks at
the ``probes`` nearest axes of every table; what it finds there is ranked by the exact cosine of the
original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Vectors and queries of one axis that meet in one task; more are dealt out by hash over pairs of parts.
AXIS_ROWS = 20_000
AXIS_QUERIES = 20_000
QUERY_BLOCK = 512


class CrossPolytope:
    """The axes of vectors in each table."""

    def __init__(self, dim: int, tables: int, seed: int) -> None:
        self.width = 1 << max(dim - 1, 0).bit_length()
        draw = np.random.default_rng(seed)
        self.signs = draw.choice([-1.0, 1.0], (tables, 3, self.width))

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        n, width, h = x.shape[0], self.width, 1
        while h < width:
            x = x.reshape(n, width // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        return x / np.sqrt(width)

    def axes(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest signed axes, nearest first: ``2 * place + (1 if negative)``."""
        x = np.zeros((len(unit), self.width))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs[table]:
            x = self._hadamard(x * signs)
        both = np.stack([x, -x], axis=2).reshape(len(x), -1)
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.float64).reshape(-1, dim)


def nearest(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
    tables: int = 10, probes: int = 12, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each id divisible by ``every``.

    The score is the cosine in double precision; equal scores go by the smaller id. Null and zero
    vectors, those that hold null or non-finite components and those whose length is not the most
    frequent one (of equal ones the longest) take no part, nor do null ids. Equal vectors are
    searched once, as queries too, and stand for all their ids, of which a query can need ``k + 1``. Rows that
    repeat an id and vector count once; an id with several vectors is several rows of that id. An empty
    table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    good = (
        vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.expr("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"))
    )
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size["n"]

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "v"]
            )

    rows = stored(good.where(F.size("v") == dim).mapInArrow(to_bytes, "id bigint, v binary"), "vectors")
    # The ids that can be among k results and the query itself; ranks are pruned before the shuffle.
    first = Window.partitionBy("v").orderBy("id")
    kept = rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    distinct = stored(
        kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("rep", F.element_at("ids", 1)),
        "distinct",
    )
    polytope = CrossPolytope(dim, tables, seed)

    def hashed(n: int):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, len(whole), 2_000):
                    batch = whole.slice(i, 2_000)
                    x = _matrix(batch.column("v"), dim)
                    scale = np.abs(x).max(1, keepdims=True)
                    unit = x / scale
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    for t in range(tables):
                        axes = polytope.axes(unit, t, n)
                        take = np.repeat(np.arange(len(x)), n)
                        part = batch.take(pa.array(take))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(take), t, np.int32)), pa.array(axes.ravel().astype(np.int32)),
                             part.column(0), part.column(1)],
                            names=["table", "axis", *batch.schema.names],
                        )

        return place

    index = stored(
        distinct.select("rep", "v").mapInArrow(hashed(1), "table int, axis int, rep bigint, v binary"), "index"
    )
    queries = stored(
        rows.where(F.col("id") % every == 0).distinct().join(distinct.select("rep", "v"), "v")
        .select(F.col("id").alias("query_id"), F.col("rep").alias("asked")),
        "queries",
    )
    asked = (
        distinct.join(queries.select(F.col("asked").alias("rep")).distinct(), "rep")
        .select(F.col("rep").alias("asked"), "v")
        .mapInArrow(hashed(probes), "table int, axis int, asked bigint, v binary")
    )

    def parts(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy("table", "axis").agg(
            F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)
        )

    # As many rows as tables and axes, whatever the input.
    sizes = F.broadcast(stored(
        parts(index, AXIS_ROWS, "parts").join(parts(asked, AXIS_QUERIES, "asked_parts"), ["table", "axis"]),
        "parts",
    ))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    left = index.join(sizes, ["table", "axis"]).withColumn("part", own).withColumn(
        "asked_part", F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1))
    ).drop("parts", "asked_parts")
    own = F.pmod(F.xxhash64("asked"), F.col("asked_parts")).cast("int")
    right = asked.join(sizes, ["table", "axis"]).withColumn("asked_part", own).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).drop("parts", "asked_parts")

    def compare(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asking):
            x = np.frombuffer(b"".join(found["v"]), np.float64).reshape(-1, dim)
            q = np.frombuffer(b"".join(asking["v"]), np.float64).reshape(-1, dim)
            x = x / np.abs(x).max(1, keepdims=True)
            q = q / np.abs(q).max(1, keepdims=True)
            norm = np.linalg.norm(x, axis=1)
            reps = found["rep"].to_numpy()
            order = np.argsort(reps)
            x, norm, reps = x[order], norm[order], reps[order]
            for i in range(0, len(q), QUERY_BLOCK):
                part = q[i:i + QUERY_BLOCK]
                score = (part @ x.T) / norm / np.linalg.norm(part, axis=1)[:, None]
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                out.append(pd.DataFrame({
                    "asked": np.repeat(asking["asked"].to_numpy()[i:i + QUERY_BLOCK], best.shape[1]),
                    "rep": reps[best].ravel(),
                    "score": np.take_along_axis(score, best, 1).ravel(),
                }))
        if not out:
            return pd.DataFrame({"asked": [], "rep": [], "score": []}).astype(
                {"asked": "int64", "rep": "int64", "score": "float64"}
            )
        return pd.concat(out)

    cell = ["table", "axis", "part", "asked_part"]
    pairs = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        compare, "asked bigint, rep bigint, score double"
    )
    found = pairs.groupBy("asked", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    each = (
        top.join(distinct.select("rep", "ids"), "rep")
        .select("asked", "score", F.explode("ids").alias("vec_id"))
        .join(queries, "asked").where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.least("score", F.lit(1.0)).alias("score")
    )
