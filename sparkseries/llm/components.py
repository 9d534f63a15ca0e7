"""Connected components of a graph given as links, by alternating stars.

No group of links meets in one place: minima are partial aggregates, and they come back to the links
through joins whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Link every larger (or smaller or equal) neighbour of a node to the node's smallest one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.where("b > a") if larger else both.where("b < a")
    least = both if larger else near
    least = least.groupBy("a").agg(F.min("b").alias("least")).select(
        "a", F.least("a", "least").alias("least")
    )
    moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not larger:
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links (a, b)``: the smallest node that it reaches."""
    now = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    mark = None
    while True:
        now = stored(_stars(_stars(now, True), False), "stars")
        # Each link goes to a smaller node; when sums and counts stay, nothing moves any more.
        seen = tuple(now.agg(
            F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")),
            F.sum(F.col("b").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(a, b))"),
        ).first())
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
