"""Grams of up to seven bytes as numbers, and which of them a text holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of the longest gram: with its size it fills a bigint.
GRAM = 7
# Places of a text that are looked at together.
PIECE = 1 << 16
# Marks have 32 bits for each gram, rounded up, up to so many words of 64 bits. Beyond, more grams that
# are not looked for pass them, to be dropped by the join that follows.
MARK_WORDS = 1 << 20
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _slots(codes: np.ndarray, factor: int, words: int) -> np.ndarray:
    return ((codes * np.uint64(factor)) >> np.uint64(58 - (words.bit_length() - 1))).astype(np.int64)


def id_grams(ids: pa.Array) -> pa.Array:
    """All grams of seven bytes of each id; a shorter id is its own gram."""
    def codes(id: bytes) -> list[int]:
        n = min(len(id), GRAM)
        return list({int.from_bytes(id[i:i + n], "big") << 8 | n for i in range(len(id) - n + 1)})

    lists = [codes(x) for x in pc.cast(ids, pa.binary()).to_pylist()]
    flat = np.array([c for x in lists for c in x], np.uint64).view(np.int64)
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


Marks = tuple[np.ndarray, np.ndarray]


def marks(grams: DataFrame) -> Marks:
    """Bits for the numbers in column ``gram``, for every one of them three, and the bytes that grams start with.

    They come to the driver, 8 MB at most.
    """
    words = 1
    while words < min(MARK_WORDS, grams.count() // 2):
        words *= 2

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            slots = np.unique(np.concatenate([_slots(codes, f, words) for f in FACTORS]))
            word, first = np.unique(slots >> 6, return_index=True)
            bits = np.uint64(1) << (slots & 63).astype(np.uint64)
            bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = np.zeros(words, np.uint64)
    rows = grams.select("gram").mapInArrow(set_bits, "word bigint, bits bigint").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    found[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    starts = np.zeros((GRAM + 1, 256), bool)
    size = F.col("gram").bitwiseAND(F.lit(255))
    first = F.expr("shiftrightunsigned(gram, cast(8 * (gram & 255) as int)) & 255")
    for row in grams.select(size.alias("size"), first.alias("first")).distinct().collect():
        starts[row["size"], row["first"]] = True
    return found, starts


def _marked(texts: pa.Array, sizes: list[int], marks: Marks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, grams)``, piece by piece, of the grams of those sizes, ascending, that ``marks`` let pass."""
    texts = pc.fill_null(pc.cast(texts, pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if first == last:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    bits, starts = marks
    for start in range(first, last, PIECE):
        n = min(PIECE, last - start)
        piece = np.zeros(n + GRAM, np.uint64)
        held = data[start:min(start + n + GRAM, last)]
        piece[:len(held)] = held
        number, size = np.zeros(n, np.uint64), 0
        for want in sizes:
            while size < want:
                number = number << np.uint64(8) | piece[size:size + n]
                size += 1
            places = np.flatnonzero(starts[size][held[:n]])
            codes = number[places] << np.uint64(8) | np.uint64(size)
            for factor in FACTORS:
                slots = _slots(codes, factor, len(bits))
                passed = np.flatnonzero(bits[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1))
                codes, places = codes[passed], places[passed]
            places += start
            rows = np.searchsorted(offsets, places, "right") - 1
            inside = places + size <= offsets[rows + 1]
            yield rows[inside], codes[inside].view(np.int64)


def count_grams(texts: DataFrame, sizes: list[int], wanted: Marks) -> DataFrame:
    """``(gram, n)``: how often the one column of ``texts`` holds each gram that the marks let pass."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _marked(batch.column(0), sizes, wanted):
                grams, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n, pa.int64())], names=["gram", "n"])

    return texts.mapInArrow(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def held_grams(sizes: list[int], wanted: Marks):
    """A function of a text column: the different grams in a text that the marks let pass."""
    def held(texts: pa.Array) -> pa.Array:
        found = list(_marked(texts, sizes, wanted))
        rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
        codes = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((codes, rows))
        rows, codes = rows[order], codes[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
        ends = np.searchsorted(rows[fresh], np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[fresh]))

    return F.arrow_udf(held, "array<bigint>")
