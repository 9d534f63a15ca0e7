"""Pack tokenised documents into sequences of balanced attention cost.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n * n``. Documents are
packed in blocks of about ``block_tokens`` tokens of one partition, without a shuffle: full sequences
are cut off first; the rests, in descending order, go to the sequence of the lowest cost that has
room, and are cut where none has.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Beyond so long a run of white space the pattern is matched by ``tokenizers``, whose matching is not nested.
LONG_SPACE = re.compile(r"\s{1000}")
# Ids are given out in rows of about so many bytes.
OUT_BYTES = 4 << 20
# A block also ends after so many documents.
BLOCK_DOCS = 50_000

SCHEMA = (
    "doc_id {id}, start bigint, length bigint, ids {ids}, doc_tokens bigint, sequence_id bigint, "
    "offset bigint"
)


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (``.json`` of ``tokenizers``).

    The vocabulary is read from the file and applied by ``tiktoken``, which gives the same ids in less
    time. Strings of the file's added tokens are their ids in a text, as the file has it, or plain
    text with ``added=False``.
    """

    def __init__(self, path: str, added: bool = True) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in tokenizer.get_vocab(with_added_tokens=False).items()
            if all(c in byte_of for c in token)
        }
        own = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in own}
        self.added = own if added else {}
        longest = sorted(self.added, key=len, reverse=True)
        self.borders = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.tokens = {i: token for token, i in ranks.items()}
        import public_tokenizers

        self.encode = tiktoken.Encoding(
            "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        tokenizer.encode_special_tokens = True
        self.tokenizer = tokenizer

    def ids(self, text: str) -> np.ndarray:
        if self.borders and self.borders.search(text):
            parts = [
                np.array([self.added[part]], np.uint32) if part in self.added else self.plain(part)
                for part in self.borders.split(text)
            ]
            return np.concatenate(parts)
        return self.plain(text)

    def plain(self, text: str) -> np.ndarray:
        if LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.encode(text), np.uint32)


def assign(
    lengths: list[int], capacity: int, linear: float, quadratic: float
) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(index, start, length)`` that hold all of ``lengths``.

    There are as many sequences as the tokens need. Descending lengths go to the sequence of the
    lowest cost with room for them, the first of those alike. A piece that fits into none is cut to
    what the emptiest holds, and its rest takes its turn by its own length.
    """
    count = -(-sum(lengths) // capacity)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    room, cost = [capacity] * count, [0.0] * count
    pieces = [(-n, index, 0) for index, n in enumerate(lengths) if n]
    heapq.heapify(pieces)
    # Lengths go down, so a sequence that has room for one has room for all that follow it.
    fitting: list[tuple[float, int]] = []
    others = [(-capacity, i) for i in range(count)]
    while pieces:
        n, index, start = heapq.heappop(pieces)
        n = -n
        while others and -others[0][0] >= n:
            i = heapq.heappop(others)[1]
            heapq.heappush(fitting, (cost[i], i))
        if fitting:
            i = heapq.heappop(fitting)[1]
        else:
            i = heapq.heappop(others)[1]
            heapq.heappush(pieces, (room[i] - n, index, start + room[i]))
            n = room[i]
        sequences[i].append((index, start, n))
        room[i] -= n
        cost[i] += linear * n + quadratic * n * n
        if room[i]:
            heapq.heappush(others, (-room[i], i))
    return sequences


def pack(
    docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = 2048,
    end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 4096, block_tokens: int = 2_000_000,
    form: str = "array",
) -> DataFrame:
    """A row for each piece of each row of ``docs``, with its ids.

    ``ids`` is an array, or with ``form="bytes"`` the same as little-endian 32-bit numbers. The ids of
    a sequence, by ``offset``, are what a model is given.

    A document is its ids followed by ``end_id``; null texts and empty ones are that id alone. Only
    the last sequence of a block can be short: padding is under ``capacity`` for each
    ``block_tokens`` or ``BLOCK_DOCS`` documents. Sequence ids hold the partition in their upper bits; a partition that is
    computed again from the same file gives the same pieces. Null and repeated ids are packed like
    others; a document longer than a block is a block of its own. An empty table gives an empty
    result; other columns are not looked at.
    """
    kind = docs.schema[id].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteBpe(path)
        first = TaskContext.get().partitionId() << 32
        names, held, tokens = [], [], 0

        def block(names: list, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows = []

            def add(doc: int, start: int, n: int, sequence: int, offset: int) -> None:
                ids = held[doc]
                rows.append((names[doc], start, n, ids[start:start + n], len(ids), sequence, offset))

            rests, whole = [], []
            for doc, ids in enumerate(held):
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    add(doc, start, capacity, first, 0)
                    first += 1
                if full < len(ids):
                    rests.append(len(ids) - full)
                    whole.append((doc, full))
            for sequence in assign(rests, capacity, linear, quadratic):
                offset = 0
                for index, start, n in sequence:
                    doc, full = whole[index]
                    add(doc, full + start, n, first, offset)
                    offset += n
                first += 1
            step = max(1, OUT_BYTES // (4 * capacity))
            for i in range(0, len(rows), step):
                columns = [list(c) for c in zip(*rows[i:i + step])]
                if form == "array":
                    ends = np.cumsum([0, *map(len, columns[3])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(ends, np.concatenate(columns[3]).astype(np.int32))
                else:
                    ids = pa.array([c.astype("<u4").tobytes() for c in columns[3]], pa.binary())
                plain = [pa.array(c, pa.int64()) for c in columns[1:3] + columns[4:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], arrow_id), *plain[:2], ids, *plain[2:]], names=out_names
                )

        arrow_id = None
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokenizer.ids(value.as_py()), np.uint32(end_id))
                names.append(name)
                held.append(ids)
                tokens += len(ids)
                if tokens >= block_tokens or len(held) >= BLOCK_DOCS:
                    yield from block(names, held)
                    names, held, tokens = [], [], 0
        if held:
            yield from block(names, held)

    schema = SCHEMA.format(
        id=kind.simpleString(), ids="array<int>" if form == "array" else "binary"
    )
    out_names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        pieces, schema
    )
