"""Transforms of whole datasets: disorder, extension and splitting by id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import TAG, TIME
from ..storage import cut, join_measured
from .grams import GRAM, count_grams, held_grams, id_grams, marks
from .ranking import number_rows

# Copies appended by an extension, and the share of batches that are shuffled.
EXTENSION_COPIES = 1000
SHUFFLED_SHARE = 0.1
# Folders that a task writes when rows are split by id, and rows of one of their files.
TASK_FOLDERS = 200
FILE_ROWS = 1_000_000


def jitter_time(
    df: DataFrame,
    std_dev: float = 0.0,
    seed: int = 0,
    time: str = TIME,
    by: list[str] | None = None,
) -> DataFrame:
    """Move integer times by a normally distributed amount, to make out-of-order input.

    The amount is drawn from a hash of the row (or of the columns ``by``), so a repeated
    task moves a row to the same place.
    """
    if not std_dev:
        return df
    columns = [F.col(f"`{c}`") for c in by or df.columns]

    def uniform(stream: int) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *columns), F.lit(1 << 53))
        return (draw + 1) / F.lit(float(1 << 53))

    normal = F.sqrt(F.lit(-2.0) * F.ln(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))
    moved = F.col(time) + (normal * F.lit(float(std_dev))).cast("bigint")
    return df.withColumn(time, moved)


def shuffle_batches(
    df: DataFrame,
    batch: str,
    position: str,
    share: float = SHUFFLED_SHARE,
    seed: int = 0,
) -> DataFrame:
    """Sort rows by batch and position, but put a share of the batches in random order inside.

    The choice and the order come from hashes, so a repeated task gives the same rows.
    """
    million = 1_000_000
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(batch)), F.lit(million))
    chosen = draw < F.lit(int(share * million))
    rank = F.when(chosen, F.xxhash64(F.lit(seed), F.col(batch), F.col(position))).otherwise(
        F.col(position)
    )
    keyed = df.withColumn("__rank", rank)
    return (
        keyed.repartitionByRange(batch, "__rank").sortWithinPartitions(batch, "__rank")
        .drop("__rank")
    )


def extend_series(
    df: DataFrame,
    copies: int = EXTENSION_COPIES,
    time: str = TIME,
    tag: str = TAG,
) -> DataFrame:
    """Every series followed by ``copies`` repetitions of its values in steps of one time unit.

    The first appended point repeats the last time of the series.
    """
    numbered = number_rows(df, [tag], [time], name="__row_no")
    lengths = cut(
        df.groupBy(tag).agg(F.max(time).alias("__last"), F.count(F.lit(1)).alias("__n"))
    )
    copy = F.explode(F.sequence(F.lit(-1), F.lit(copies - 1))).alias("__copy")
    moved = F.col("__last") + F.col("__copy") * F.col("__n") + F.col("__row_no") - 1
    rows = join_measured(numbered, lengths, [tag]).select("*", copy)
    return rows.withColumn(
        time, F.when(F.col("__copy") < 0, F.col(time)).otherwise(moved)
    ).select(*df.columns)


def lines_with_ids(lines: DataFrame, ids: DataFrame, text: str, key: str, on: str) -> DataFrame:
    """``lines`` with each listed id that their text contains as column ``on``, a row for each pair.

    An id of up to seven bytes is a gram, and the lines that hold the gram are its lines. A longer id is
    looked for by its rarest gram of seven bytes: grams of the ids are counted over all lines, and the
    lines that hold the chosen one are searched. Null and empty ids and null texts match nothing;
    repeated ids count once; repeated rows and keys, also null ones, keep their rows. ``lines`` has no
    column ``on``.
    """
    wanted = ids.select(F.col(f"`{on}`").cast("string").alias("__id")).where(F.length("__id") > 0).distinct()
    listed = wanted.select("__id", F.arrow_udf(id_grams, "array<bigint>")("__id").alias("grams"))
    own = cut(listed.select("__id", F.explode("grams").alias("gram")))
    whole = F.octet_length("__id") <= GRAM
    sizes = sorted(r[0] for r in own.where(whole).select(F.octet_length("__id")).distinct().collect())
    texts = lines.select(F.col(f"`{text}`").cast("string").alias("__text"))
    short, long = own.where(whole), own.where(~whole)

    def holding(anchors: DataFrame, sizes: list[int]) -> DataFrame:
        grams = held_grams(sizes, marks(anchors))(F.col(f"`{text}`").cast("string"))
        held = lines.withColumn("__grams", grams).select(
            *[F.col(f"`{c}`") for c in lines.columns], F.explode("__grams").alias("gram"))
        return join_measured(held, anchors, ["gram"]).drop("gram").withColumnRenamed("__id", on)

    found = holding(short, sizes) if sizes else None
    if sizes and long.isEmpty():
        return found
    counts = count_grams(texts, [GRAM], marks(long.select("gram").distinct()))
    anchors = cut(long.join(counts, "gram", "left").groupBy("__id").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    searched = holding(anchors, [GRAM]).where(F.contains(F.col(f"`{text}`"), F.col(on)))
    return searched if found is None else found.unionByName(searched)


def split_by_id(readings: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Readings of listed ids."""
    return readings.join(ids.select(on), on, "left_semi")


def write_split(
    readings: DataFrame, ids: DataFrame, on: str, path: str, fields: list[str], mode: str = "overwrite",
    text: str | None = None, key: str | None = None,
) -> None:
    """A folder for each listed id that has readings, with the columns ``fields``.

    With ``text`` and ``key`` the readings of an id are the rows whose text contains it
    (:func:`lines_with_ids`). The folders are dealt to tasks by id, so that each task writes a bounded
    number of them; an id with very many readings has several files.
    """
    listed = split_by_id(readings, ids, on) if text is None else lines_with_ids(readings, ids, text, key, on)
    listed = cut(listed.select(on, *fields))
    sizes = cut(listed.groupBy(on).agg((F.count(F.lit(1)) / FILE_ROWS).cast("bigint").alias("__more")))
    files = sizes.agg(F.sum(F.col("__more") + 1)).first()[0] or 0
    hot = sizes.where("__more > 0")
    deal = F.pmod(F.monotonically_increasing_id(), F.coalesce("__more", F.lit(0)) + 1)
    dealt = join_measured(listed, hot, [on], "left").withColumn("__file", deal)
    parts = max(1, -(-files // TASK_FOLDERS))
    clustered = dealt.repartition(parts, on, "__file").sortWithinPartitions(on, *fields).select(on, *fields)
    clustered.write.mode(mode).partitionBy(on).parquet(path)
