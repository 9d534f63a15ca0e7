"""Groups of spelling variants by permuterm rotations.

A word is marked at its end and turned so that the part after an edited character, the mark and the
part before it come first. Two words that differ by one replaced character share that rotation up to
its last character; a word that lacks the character is, marked and turned, that shared part itself.
So sorted rotations bring all neighbours of a kind into one short group: at most one word for each
character of the alphabet and one without it. Groups are scanned where they lie; each word takes
from its group the number of its neighbours there and the most frequent of them, so that what leaves
a group is as long as the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
# Ends a word; words must not hold it. It sorts before all letters.
MARK = "\x01"
# Rotations up to this many code points are kept as text; longer ones as their length, place and two
# residues, so that a word of any length costs memory in proportion to its length.
TEXT_POINTS = 64
# Fixed moduli and base of the residues of long rotations.
MODULI = ((1 << 61) - 1, (1 << 89) - 1)
BASE = 1_000_003


def words_of(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least_points: int = 7, least_n: int = 2,
    damage: int | None = 31,
) -> DataFrame:
    """``(word, n)``: letter runs of all texts in ASCII lower case, with their occurrences.

    With ``damage``, a run whose unsigned CRC-32 of ``<id>:<run>`` is a multiple of it loses the code
    point at that number modulo its length. Words shorter than ``least_points`` or rarer than
    ``least_n`` are left out. Null texts hold no words; a null id is written as nothing.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(text_of(text)), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= least_points)
    word = F.col("run")
    if damage is not None:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(
            F.col("h") % damage == 0,
            F.concat(F.expr("substring(run, 1, cast(h % char_length(run) as int))"), _after("run", at + 2)),
        ).otherwise(word)
    return (
        runs.select(word.alias("word")).where(F.char_length("word") >= least_points)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)
    )


def _after(word: str, place: Column) -> Column:
    """The code points of ``word`` from ``place`` on, counted from 1."""
    return F.substring(F.col(word), place, F.char_length(word))


def rotations(words: DataFrame) -> DataFrame:
    """``(key, c, first, wid, n)``: the group of each edit of each word.

    ``c`` is the character that the group skips, null for the word that lacks it. ``first`` is false
    where a character equal to ``c`` goes before it: deleting either gives the same word, which is
    counted once.
    """
    size = F.char_length("word")
    short = words.where(size <= TEXT_POINTS + 1).select(
        "wid", "n", "word", F.explode(F.expr("sequence(0, char_length(word))")).alias("at")
    )
    before = F.substring(F.col("word"), F.lit(1), F.col("at"))
    c = F.substring(F.col("word"), F.col("at") + 1, F.lit(1))
    skipped = short.where((F.col("at") < size) & (size <= TEXT_POINTS)).select(
        F.concat(_after("word", F.col("at") + 2), F.lit(MARK), before).alias("key"), c.alias("c"),
        ((F.col("at") == 0) | (c != F.substring(F.col("word"), F.col("at"), F.lit(1)))).alias("first"),
        "wid", "n",
    )
    whole = short.where(size < TEXT_POINTS).select(
        F.concat(_after("word", F.col("at") + 1), F.lit(MARK), before).alias("key"),
        F.lit(None).cast("string").alias("c"), F.lit(True).alias("first"), "wid", "n",
    )
    long = words.where(size >= TEXT_POINTS).select("wid", "n", "word").mapInArrow(
        _long_rotations, "key string, c string, first boolean, wid bigint, n bigint"
    )
    return skipped.union(whole).union(long)


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows for rotations beyond ``TEXT_POINTS``, their keys as residues."""
    names = ["key", "c", "first", "wid", "n"]
    for batch in batches:
        for wid, n, word in zip(*(column.to_pylist() for column in batch.columns)):
            size = len(word)
            powers, sums = [], []
            for modulus in MODULI:
                power, total = [1], [0]
                for letter in word:
                    total.append((total[-1] * BASE + ord(letter)) % modulus)
                    power.append(power[-1] * BASE % modulus)
                power.append(power[-1] * BASE % modulus)
                powers.append(power)
                sums.append(total)

            def key(until: int, since: int) -> str:
                """Of the part from ``since`` on, the mark and the part up to ``until``."""
                tail = size - since
                residues = [
                    ((s[size] - s[since] * p[tail]) * p[until + 1] + ord(MARK) * p[until] + s[until]) % m
                    for m, p, s in zip(MODULI, powers, sums)
                ]
                return f"{until + 1 + tail}{MARK}{tail}{MARK}{residues[0]:x}{MARK}{residues[1]:x}"

            rows = []
            if size > TEXT_POINTS:
                rows += [
                    (key(i, i + 1), word[i], i == 0 or word[i] != word[i - 1]) for i in range(size)
                ]
            rows += [(key(i, i), None, True) for i in range(size + 1)]
            for at in range(0, len(rows), 10_000):
                keys, cs, firsts = zip(*rows[at:at + 10_000])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), pa.array(cs, pa.string()), pa.array(firsts),
                    pa.array([wid] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int64()),
                ], names=names)


def _groups(words: DataFrame) -> DataFrame:
    """``(members)`` of the groups with more than one word, most frequent first, then by word order."""
    return (
        rotations(words).groupBy("key")
        .agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "wid", "c", "first")).alias("members"))
        .where("size(members) > 1")
        .select(F.array_sort("members").alias("members"))
    )


# Of a member ``e`` of a group, another member ``x`` is a neighbour if both have a character here, or
# one has and it is the first of its kind.
_NEAR = (
    "filter(members, x -> x.wid != e.wid and "
    "if(x.c is null or e.c is null, (x.c is null or x.first) and (e.c is null or e.first), true))"
)


def neighbours(words: DataFrame) -> DataFrame:
    """``(wid, near_wid)``, both ways, for each two words of ``(wid, word, n)`` one edit apart."""
    return (
        _groups(words).select("members", F.explode("members").alias("e"))
        .select("e.wid", F.explode(F.expr(f"transform({_NEAR}, x -> x.wid)")).alias("near_wid"))
    )


def numbered(words: DataFrame) -> DataFrame:
    """``(wid, word, n)``, stored, with ids that ascend in code-point order of the words."""
    words = stored(words, "words")
    return stored(
        words.repartitionByRange("word").sortWithinPartitions("word")
        .select(F.monotonically_increasing_id().alias("wid"), "word", "n"),
        "numbered",
    )


def roots(edges: DataFrame) -> DataFrame:
    """``(wid, root)`` for ``edges (wid, form)``, following forms to the last.

    Every round doubles the steps taken, so rounds grow with the logarithm of the longest chain.
    """
    now = stored(edges.select("wid", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        moved = stored(now.join(ahead, "root", "left"), "roots")
        if moved.where("further is not null").isEmpty():
            return now
        now = moved.select("wid", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """A row for each of the distinct ``words (word, n)``: ``word, n, n_near, form, form_n, root``.

    Words are near if one inserted, deleted or replaced code point makes one the other. ``form`` is
    the near word of the largest ``n``, the smallest in code-point order of those alike, if that is
    at least ``ratio`` times the word's own; ``root`` is what forms lead to in the end, the word
    itself if it has none. ``n_near`` counts all near words. An empty table gives an empty result.
    """
    words = numbered(words.select("word", "n"))
    near = _groups(words).select("members", F.explode("members").alias("e")).select(
        "e.wid", F.expr(_NEAR).alias("near")
    ).where("size(near) > 0").groupBy("wid").agg(
        F.sum(F.size("near")).alias("n_near"), F.min(F.expr("near[0]")).alias("best")
    ).select("wid", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.wid").alias("best"))
    found = stored(
        words.join(near, "wid", "left").withColumn(
            "form", F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best"))
        ).select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form"),
        "near",
    )
    ends = roots(found.where("form is not null").select("wid", "form"))
    names = words.select(F.col("wid").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    last = words.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    return (
        found.join(names, "form", "left").join(ends, "wid", "left").join(last, "root", "left")
        .select(
            "word", "n", "n_near", F.col("form_word").alias("form"), "form_n",
            F.coalesce("root_word", "word").alias("root"),
        )
    )
