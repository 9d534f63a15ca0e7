"""Near duplicates by SimHash, found at the anchors of a covering code.

A fingerprint has two halves of 32 bits. If two fingerprints differ in at most ``max_bits`` bits, one
half differs in at most ``max_bits // 2`` (pigeonhole). The anchors of a half are the words of the
perfect Hamming code of length 31 with one free bit: covering radius 1, so every half has a home
anchor at most one bit away. A half goes to every anchor within covering radius plus threshold that
can be the home of a half within the threshold (17 of them, or 2 for a code word), and fingerprints
are compared where the home of one of them lies: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_decided, stored, text_of
from .components import components

# Rows of one anchor that are compared in one task; more are dealt out over pairs of parts.
ANCHOR_ROWS = 20_000
# Up to so many rows of an anchor are compared place by place, with all anchors of a batch at once.
SMALL_GROUP = 16


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text``, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return hash_of(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    hashes = np.array(
        [
            hash_of(joined[a:b], seed)
            for a, b in zip(starts[: 1 - shingle or None].tolist(), (ends[shingle - 1:] - 1).tolist())
        ],
        dtype=">u8",
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i:i + 65_536].view("u1").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprint_of(text: str, shingle: int) -> Column:

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            values = np.array([fingerprint(t, shingle) for t in part], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return of(text_of(text)).alias("fp")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number; null texts count as empty."""
    return docs.select(F.col(f"`{id}`").alias("doc_id"), _fingerprint_of(text, shingle))


def _syndromes(first: int) -> np.ndarray:
    """For each 16-bit number the exclusive or of the places of its set bits, from ``first`` on."""
    out = np.zeros(1 << 16, np.uint32)
    for bit in range(16):
        out[1 << bit:2 << bit] = out[:1 << bit] ^ np.uint32(first + bit)
    return out


class Anchors:
    """Home anchors of 32-bit halves: Hamming code on bits 0 to 30, bit 31 free."""

    def __init__(self) -> None:
        self.low, self.high = _syndromes(1), _syndromes(17)

    def home(self, half: np.ndarray) -> np.ndarray:
        wrong = self.low[half & np.uint32(0xFFFF)] ^ self.high[half >> np.uint32(16) & np.uint32(0x7FFF)]
        flip = np.left_shift(np.uint32(1), np.maximum(wrong, np.uint32(1)) - np.uint32(1))
        return np.where(wrong > 0, half ^ flip, half)


def _flip_masks(bits: int) -> np.ndarray:
    """All 32-bit numbers with at most ``bits`` set bits."""
    masks = {0}
    for _ in range(bits):
        masks |= {m ^ 1 << i for m in masks for i in range(32)}
    return np.array(sorted(masks), dtype=np.uint32)


def _replicas(fps: DataFrame, max_bits: int) -> DataFrame:
    """Rows ``(anchor, fp, home)``: every fingerprint at all anchors where it may meet another."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, masks = Anchors(), _flip_masks(max_bits // 2)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 10_000):
                part = fp[i:i + 10_000].view(np.uint64)
                for side in (0, 1):
                    half = (part >> np.uint64(32 * side)).astype(np.uint32)
                    home = anchors.home(half)
                    at = np.sort(anchors.home(half[:, None] ^ masks[None, :]), axis=1)
                    new = np.ones(at.shape, bool)
                    new[:, 1:] = at[:, 1:] != at[:, :-1]
                    row, col = np.nonzero(new)
                    anchor = at[row, col]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor.astype(np.int64) | side << 32),
                            pa.array(part[row].view(np.int64)),
                            pa.array(anchor == home[row]),
                        ],
                        names=["anchor", "fp", "home"],
                    )

    return fps.mapInArrow(place, "anchor bigint, fp bigint, home boolean")


def _links_of_group(fp: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what the comparisons of one anchor join, at most one for each row."""
    label = np.arange(len(fp))
    links = []
    for i in np.nonzero(home)[0]:
        near = np.nonzero(np.bitwise_count(fp ^ fp[i]) <= max_bits)[0]
        labels, first = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            own = label[i]
            links += [(i, near[j]) for k, j in zip(labels, first) if k != own]
            label[np.isin(label, labels)] = own
    return links


def _compare(groups: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` among the rows of each ``anchor`` and ``cell``, which arrive sorted."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            edges = np.nonzero(np.diff(key))[0] + 1
            begin = np.concatenate(([0], edges))
            size = np.diff(np.concatenate((begin, [len(key)])))
            small = np.repeat(size <= SMALL_GROUP, size)
            a, b = [], []
            for k in range(1, min(SMALL_GROUP, int(size.max()))):
                one = np.nonzero(
                    small[:-k] & (key[:-k] == key[k:]) & (home[:-k] | home[k:])
                    & (np.bitwise_count(fp[:-k] ^ fp[k:]) <= max_bits)
                )[0]
                a.append(one)
                b.append(one + k)
            for at, n in zip(begin[size > SMALL_GROUP], size[size > SMALL_GROUP]):
                found = _links_of_group(fp[at:at + n], home[at:at + n], max_bits)
                if found:
                    pairs = np.array(found) + at
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"]
                )

        kept = None
        for batch in batches:
            anchor, cell, fp, home = (
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("anchor", "cell", "fp", "home")
            )
            rows = [anchor, cell, fp.view(np.uint64), home]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            if not len(rows[0]):
                continue
            # The last group may go on in the next batch.
            other = np.nonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[0]
            cut = int(other[-1]) + 1 if len(other) else 0
            kept = [x[cut:] for x in rows]
            done = [x[:cut] for x in rows]
            change = (np.diff(done[0]) != 0) | (np.diff(done[1]) != 0)
            yield from links(np.concatenate(([0], np.cumsum(change)))[:cut], done[2], done[3])
        if kept is not None:
            yield from links(np.zeros(len(kept[0]), np.int64), kept[2], kept[3])

    return groups.mapInArrow(compare, "a bigint, b bigint")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``(a, b)`` that join the distinct fingerprints ``fp`` at ``max_bits`` bits or fewer.

    Two fingerprints are in one component of the result exactly if a chain of such pairs leads from
    one to the other. Anchors with more than ``ANCHOR_ROWS`` rows are dealt out: rows go to parts by
    hash, and each pair of parts is compared in a cell of its own.
    """
    rows = stored(_replicas(fps, max_bits), "anchors")
    hot = stored(
        rows.groupBy("anchor").count().where(F.col("count") > ANCHOR_ROWS).select(
            "anchor", F.ceil(F.col("count") / ANCHOR_ROWS).cast("int").alias("parts")
        ),
        "hot",
    )
    one = rows.withColumn("cell", F.lit(0).cast("long"))
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        split = rows.join(hot, "anchor").withColumn("part", own)
        as_home = split.where("home").withColumn("other", F.explode(every)).select(
            "anchor", "fp", "home", (F.col("part") * F.col("parts") + F.col("other")).cast("long").alias("cell")
        )
        as_guest = split.withColumn("other", F.explode(every)).where("not (home and other = part)").select(
            "anchor", "fp", F.lit(False).alias("home"),
            (F.col("other") * F.col("parts") + F.col("part")).cast("long").alias("cell"),
        )
        one = one.join(hot, "anchor", "left_anti").select("anchor", "fp", "home", "cell")
        one = one.union(as_home).union(as_guest)
    dealt = one.select("anchor", "cell", "fp", "home").repartition("anchor", "cell")
    return _compare(dealt.sortWithinPartitions("anchor", "cell"), max_bits).distinct()


def _least(prints: DataFrame, column: str, max_bits: int) -> DataFrame:
    """Each ``fp`` with the least ``column`` of its component, as ``least``; nulls do not count."""
    if not 0 <= max_bits <= 3:
        raise ValueError("anchors are made for at most 3 differing bits")
    distinct = stored(prints.groupBy("fp").agg(F.min(column).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("least"))
    return stored(labelled.select("fp", "root").join(least, "root").select("fp", "least"), "labels")


def near_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for each row of ``docs``.

    Words are runs of other than ASCII white space after lower-casing A-Z; a text with fewer words
    than a shingle is one shingle, a text without words has fingerprint zero, and null counts as
    empty. Fingerprints link at ``max_bits`` (0 to 3) differing bits or fewer; ``component_id`` is
    the smallest id of the component, null if it has only null ids. Repeated rows stay. An empty
    table gives an empty result; other columns are not looked at.
    """
    prints = stored(fingerprints(docs, id, text, shingle), "fingerprints")
    return prints.join(_least(prints, "doc_id", max_bits), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept.

    It is the row of the smallest id, null last, and of equal ids that of the least text digest. Rows
    that share an id, or have none, stay if their texts are in no group with another row.
    """
    digest = F.sha2(text_of(text).cast("binary"), 256)
    own = F.col(f"`{id}`")
    row = F.struct(own.isNull().alias("none"), own.alias("id"), digest.alias("digest"))
    prints = stored(docs.select(row.alias("row"), _fingerprint_of(text, shingle)), "fingerprints")
    decided = prints.join(_least(prints, "row", max_bits), "fp").select(
        F.col("row.id").alias("doc_id"), F.col("row.digest").alias("text_sha256"),
        F.col("row").eqNullSafe(F.col("least")).alias("kept"),
    )
    return keep_decided(docs, id, digest, stored(decided, "groups"))
