"""License notices found by MinHash over windows of a text, with column functions only.

Words are runs of a-z and 0-9 after lower-casing A-Z. Windows hold ``2 * L`` five-word shingles and
start every ``L``; a template of n shingles is sought in windows of the smallest power of two L >= n,
so that each place where it can stand lies whole within a window. A window and a template meet if one
of ``bands`` minima of their shingle hashes agree; a met window is kept if it holds at least
``containment`` of the template's distinct shingles.

With containment 0.8 the similarity of such a window is at least 0.19, and 48 bands of one row retrieve
it with probability 0.9999 or more; an exact copy (similarity over 0.25) with 0.999999.

Windows that hold none of the minimum shingles of their templates cannot meet any template in any
band, so only those are evaluated that hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_of

SHINGLE = 5
# So many templates, each of at most a few pages, are a literal of a few MB.
MOST_TEMPLATES = 10_000


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " ")), " ")


def _shingles(words: str) -> Column:
    """Hashes of the five-word shingles of array column ``words``, in order."""
    return F.expr(
        f"if(size({words}) < {SHINGLE}, cast(array() as array<bigint>), "
        f"transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64("
        + ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE)) + ")))"
    )


def _minima(shingles: str, bands: int) -> Column:
    """The shingle with the least permuted hash, for each band."""
    return F.expr(
        f"transform(sequence(1, {bands}), b -> array_min(transform({shingles}, "
        "h -> named_struct('v', xxhash64(h, b), 'h', h))).h)"
    )


def find_licenses(
    docs: DataFrame, templates: list[tuple[str, str]], id: str = "doc_id", text: str = "text",
    bands: int = 48, containment: float = 0.8,
) -> DataFrame:
    """``doc_id, license, containment, windows`` for each row of ``docs`` and template that it holds.

    ``containment`` is the largest share of the template's distinct shingles in one window, and
    ``windows`` counts the windows that hold enough of it. A template needs five words. Null and
    empty texts and those of under five words hold nothing; licenses whose texts share most of their words
    are all found, the one that is there with containment 1; rows that repeat an id are one document
    (their windows count once for each row); a null id is kept as such. An empty table or no
    templates give an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    if len(templates) > MOST_TEMPLATES:
        raise ValueError("templates are sent to every task; give fewer")
    known = (
        spark.createDataFrame(templates, "license string, body string")
        .withColumn("words", _words(F.col("body")))
        .withColumn("shingles", F.array_distinct(_shingles("words")))
        .where(F.size("shingles") > 0)
        .withColumn("step", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int"))
        .withColumn("minima", _minima("shingles", bands))
        .select("license", "shingles", "step", "minima")
        .collect()
    )
    known_schema = "license string, shingles array<bigint>, step int, minima array<bigint>"
    lookup = spark.createDataFrame([tuple(r) for r in known], known_schema)
    seeds: dict[int, set[int]] = {}
    for r in known:
        seeds.setdefault(r["step"], set()).update(r["minima"])
    if not seeds:
        return docs.select(
            F.col(f"`{id}`").alias("doc_id"), F.lit("").alias("license"),
            F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("windows"),
        ).where("false")
    shingled = docs.select(
        F.col(f"`{id}`").alias("doc_id"), _words(text_of(text)).alias("words")
    ).select("doc_id", _shingles("words").alias("all"))

    def member(value: str, of: set[int]) -> str:
        return f"{value} in (" + ", ".join(f"{h}L" if h > -(1 << 63) else str(h) for h in sorted(of)) + ")"

    # Places of seeds, and the windows of their steps around each; starts are multiples of the step.
    any_seed = member("h", set().union(*seeds.values()))
    at = F.expr(
        f"filter(transform(all, (h, i) -> if({any_seed}, cast(i as bigint), -1L)), i -> i >= 0)"
    )
    starts = F.expr("array_distinct(flatten(array(" + ", ".join(
        f"flatten(transform(filter(at, p -> {member('all[cast(p as int)]', of)}), "
        f"p -> filter(array(named_struct('step', {s}L, 'start', (p div {s}L) * {s}L), "
        f"named_struct('step', {s}L, 'start', (p div {s}L) * {s}L - {s}L)), w -> w.start >= 0)))"
        for s, of in sorted(seeds.items())
    ) + ")))")
    windows = (
        shingled.withColumn("at", at)
        # An outer generator: a filter that Spark infers for the other kind would go below the
        # projections and compute the shingles anew for each element.
        .select("doc_id", "all", F.explode_outer(starts).alias("w"))
        .where("w is not null")
        .select(
            "doc_id", F.col("w.step").cast("int").alias("step"),
            F.array_distinct(F.expr("slice(all, cast(w.start + 1 as int), cast(2 * w.step as int))")).alias("held"),
        )
        .withColumn("own", _minima("held", bands))
        .select("doc_id", "held", "step", "own")
    )
    met = windows.join(F.broadcast(lookup), "step").where(
        F.exists(F.zip_with("own", "minima", lambda a, b: a == b), lambda x: x)
    )
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    return (
        met.withColumn("share", share).where(F.col("share") >= containment)
        .groupBy("doc_id", "license")
        .agg(F.max("share").alias("containment"), F.count(F.lit(1)).alias("windows"))
    )
