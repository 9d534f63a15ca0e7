"""Mix sources to target weights with hash thresholds.

Every document has a 60-bit hash of its id. Sizes are summed by source and hash bucket, the bucket in
which a source's budget ends is refined by the next bits, and documents below the threshold are
taken. Nothing is sorted but the buckets of one source, of which there are at most 2**15.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored, text_of

LEVEL_BITS, LEVELS = 15, 4
BITS = LEVEL_BITS * LEVELS
# A table of so many sources is at most some 100 MB; a larger one is joined by shuffling.
BROADCAST_SOURCES = 500_000


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place by code point, null last, counted slice by slice."""
    slices = stored(
        sources.orderBy(F.col("source").asc_nulls_last()).select(
            "*", F.spark_partition_id().alias("slice"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        ),
        "sources",
    )
    counts = slices.groupBy("slice").count().collect()  # a row for each partition
    offsets, before = [], 0
    for row in sorted(counts):
        offsets.append((row["slice"], before))
        before += row["count"]
    offsets = sources.sparkSession.createDataFrame(offsets, "slice int, before long")
    return slices.join(F.broadcast(offsets), "slice").select(
        "source", "source_size", (F.col("before") + F.col("place")).alias("rank")
    )


def targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> tuple[DataFrame, int]:
    """Targets by weight, none above ``most`` times its source, and the number of sources.

    Sources whose share is above their limit get the limit, and the rest is shared anew by weight,
    until none is above. Only sums come to the driver.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("rank") % len(weights) + 1).cast("int"),
    )
    ranked = stored(_ranked(sources).withColumn("weight", weight), "ranked")
    limit = F.lit(most) * F.col("source_size")
    total, count = ranked.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    total, share, capped = total or 0, 0.0, -1
    above = F.lit(False)
    while True:
        n, held, rest = ranked.agg(
            F.coalesce(F.sum(above.cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not rest:
            break
        capped, share = n, (total - held) / rest
        above = F.col("weight") * F.lit(share) > limit
    target = F.when(above, limit.cast("double")).otherwise(F.col("weight") * F.lit(share))
    return ranked.withColumn("target", target), count


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), most: int = 3,
) -> DataFrame:
    """A row for each row of ``docs`` with its size in words and how many of them the mix takes.

    Sources, ordered by code point with null last, weigh ``weights`` in turn and share the sum of
    all sizes; no target exceeds ``most`` times its source. A source is taken whole as often as its
    target holds it; of the rest, documents are taken in the order of their hash up to the place
    where the sum comes nearest the target. Null texts have size 0, equal ids are taken together
    (null ids too), and a run on the same rows gives the same result. An empty table gives an empty
    result; other columns are not looked at.
    """
    digest = F.md5(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary"))
    rows = stored(
        docs.select(
            F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
            F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
            F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"),
        ),
        "sizes",
    )
    sources, count = targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most
    )
    small = (lambda df: F.broadcast(df)) if count <= BROADCAST_SOURCES else (lambda df: df)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    sources = stored(
        sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
            "budget", F.col("target") - F.col("whole") * F.col("source_size")
        ),
        "targets",
    )
    # The bucket where the budget ends: ``prefix`` are its bits, ``base`` what lies before it.
    part = rows.alias("r").join(
        small(sources.select(F.col("source").alias("s"), "rank", "budget")),
        F.col("source").eqNullSafe(F.col("s")),
    ).select("rank", "budget", "size", "hash", F.lit(0).cast("long").alias("base"))
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("hash", BITS - LEVEL_BITS * level)
        sums = part.groupBy("rank", "budget", "base", bucket.alias("prefix")).agg(
            F.sum("size").alias("size")
        )
        before = Window.partitionBy("rank").orderBy("prefix").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        ends = (
            sums.withColumn("upto", F.col("base") + F.sum("size").over(before))
            .where("upto > budget")
            .groupBy("rank").agg(F.min(F.struct("prefix", "upto", "size", "budget")).alias("end"))
        )
        ends = stored(ends.select(
            "rank", "end.prefix", (F.col("end.upto") - F.col("end.size")).alias("base"),
            "end.size", "end.budget",
        ), "ends")
        if level < LEVELS:
            source_rows = (
                part.drop("base", "budget") if level > 1 else part.select("rank", "size", "hash")
            )
            part = stored(
                source_rows.withColumn("prefix", bucket)
                .join(small(ends.select("rank", "prefix", "base", "budget")), ["rank", "prefix"])
                .drop("prefix"),
                "boundary",
            )
    # At the last level a bucket is one hash; it is taken if its middle lies within the budget.
    last = ends.select(
        "rank",
        F.when(2 * F.col("base") + F.col("size") <= 2 * F.col("budget"), F.col("prefix") + 1)
        .otherwise(F.col("prefix")).alias("end"),
    )
    final = sources.join(last, "rank", "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole",
        F.coalesce("end", F.lit(1 << BITS)).alias("end"),
    )
    copies = F.col("whole") + (F.col("hash") < F.col("end")).cast("long")
    return rows.join(small(stored(final, "thresholds")), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * copies).alias("taken"), copies.alias("copies"),
    )


def mixed(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), most: int = 3,
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns kept."""
    columns = docs.columns
    key, group, copies = (fresh(docs, c) for c in ("key", "key_source", "copies"))
    times = (
        mix(docs, id, text, source, weights, most).where("copies > 0")
        .select(
            F.col("doc_id").alias(key), F.col("source").alias(group), F.col("copies").alias(copies)
        )
        .distinct()
    )
    same = F.col(f"`{id}`").eqNullSafe(F.col(key)) & F.col(f"`{source}`").eqNullSafe(F.col(group))
    repeat = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return docs.join(times, same).withColumn(fresh(docs, "copy"), repeat).select(
        *[f"`{c}`" for c in columns]
    )
