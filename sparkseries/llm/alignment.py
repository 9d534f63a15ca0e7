"""Alignment of two tokenizers' tokens of the same text, and how often their tokens go together.

Both tokenizers cut the same bytes. The places where both end a token are found by a galloping
intersection of the two ascending lists of token ends: the shorter list drives, and each of its ends
is searched in the longer one with steps that double, then by halves. Common ends cut the tokens
into groups; the ranks found say which tokens overlap.

Documents are worked on in blocks. A block keeps each pair of ids once, with its links, so that a
pair that is in every text crosses the network once for each block and not for each link. A block is
made of pieces, of which one at a time is held as tokens; only links and numbers stay of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .packing import ByteBpe

# A block ends after so many bytes of text (a longer document is a block) or so many documents.
BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 5_000
# A piece ends after so many bytes. A task holds about 80 bytes for each byte of its piece.
PIECE_BYTES = 128 << 10
# Ends of the driving list that start one search; those between them start where it ended.
STRIDE = 32


def ranks(driving: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each item of ascending ``driving``, how many items of ascending ``longer`` are less."""
    low = np.zeros(len(driving), np.int64)
    if len(driving) == 0 or len(longer) == 0:
        return low
    if len(driving) > STRIDE:
        low = np.repeat(ranks(driving[::STRIDE], longer), STRIDE)[:len(driving)]
    # Gallop: all items together, each from its own place, with steps that double.
    high = low.copy()
    going = np.flatnonzero(longer[np.minimum(low, len(longer) - 1)] < driving)
    going = going[low[going] < len(longer)]
    step = 1
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, len(longer))
        inside = going[high[going] < len(longer)]
        going = inside[longer[high[inside]] < driving[inside]]
        step *= 2
    # Halve what is left between the last place below and the first one that is not.
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        below = longer[middle] < driving[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(common_a, common_b, link_a, link_b)`` of two lists of token ends over the same bytes.

    The places in both lists of the ends that are in both, and the places of all two tokens whose
    bytes overlap. The last ends must be the same.
    """
    if len(ends_a) > len(ends_b):
        # Links go up on both sides, so their order is the same whichever drives.
        common_b, common_a, link_b, link_a = overlaps(ends_b, ends_a)
        return common_a, common_b, link_a, link_b
    rank = ranks(ends_a, ends_b)
    common = ends_b[rank] == ends_a
    # A token overlaps those from the first that ends after its start to the one that holds its last byte.
    first = np.concatenate([[0], rank + common])[:-1].astype(np.int64)
    many = rank - first + 1
    link_a = np.repeat(np.arange(len(ends_a)), many)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return np.flatnonzero(common), rank[common], link_a, link_b


class Pair:
    """The two tokenizers: a byte-level BPE file and a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = ByteBpe(path_a, added=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.a.tokens.get(i, b"") for i in range(max(self.a.tokens) + 1)]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(
                bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            )
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])
        # An id as text with what follows it: inside a side of a group, at its end.
        self.names = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))]
        self.names += [f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none if the text is empty or a tokenizer does not keep its bytes."""
        out, none = [], np.zeros(0, np.int64)
        for text, ids_b in zip(texts, self.b.encode(texts, num_threads=1)):
            want = (" " + text).encode()
            ids_a = self.a.ids(" " + text)
            if (
                not text
                or b"".join([self.bytes_b[i] for i in ids_b]) != want
                or b"".join([self.bytes_a[i] for i in ids_a.tolist()]) != want
            ):
                out.append((none, none))
            else:
                out.append((ids_a.astype(np.int64), np.array(ids_b, np.int64)))
        return out

    def block(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """``(documents, pairs, counts, links)`` of some texts.

        Documents are ``(n_a, n_b, n_groups, n_links, groups)``; ``pairs`` are ids of A times 2**32
        plus ids of B, ascending, with the links that hold them; ``links`` are places in ``pairs``,
        document by document, ascending in each.
        """
        tokens = self.tokens(texts)
        n_a = np.array([len(a) for a, _ in tokens], np.int64)
        n_b = np.array([len(b) for _, b in tokens], np.int64)
        until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
        a, b = (np.concatenate([pair[k] for pair in tokens]) for k in (0, 1))
        common_a, common_b, link_a, link_b = overlaps(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))

        until_group = np.searchsorted(common_a, until_a)
        n_groups = np.diff(until_group, prepend=0)
        until_link = np.searchsorted(link_a, until_a)
        n_links = np.diff(until_link, prepend=0)

        # Every token's place in the text of all groups: those of A, then those of B.
        sizes_a, sizes_b = np.diff(common_a, prepend=-1), np.diff(common_b, prepend=-1)
        before_b = np.repeat(common_b + 1 - sizes_b, sizes_a)
        before_a = np.repeat(common_a + 1, sizes_b)
        codes = np.zeros(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[common_a], last_b[common_b] = len(self.bytes_a), len(self.bytes_b)
        codes[np.arange(len(a)) + before_b] = a + last_a
        codes[np.arange(len(b)) + before_a] = b + last_b + 2 * len(self.bytes_a)
        ends = (until_a + until_b).tolist()
        names, groups = self.names, []
        for start, end in zip([0, *ends], ends):
            groups.append("".join([names[c] for c in codes[start:end].tolist()])[:-1])

        pairs, place, counts = np.unique((a[link_a] << 32) | b[link_b], return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(texts)), n_links)
        links = (np.sort((of << 32) | place) & 0xFFFFFFFF).astype("<u4")
        documents = list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), groups))
        return documents, pairs, counts, links


class Block:
    """Documents of one block, put together from pieces; with ``digest``, groups as their SHA-256.

    ``size`` is the bytes of all texts so far; a piece ends after ``piece_bytes``.
    """

    def __init__(self, pair: Pair, piece_bytes: int, digest: bool = False) -> None:
        self.pair, self.piece_bytes, self.digest = pair, piece_bytes, digest
        self.ids, self.documents, self.parts, self.size = [], [], [], 0
        self.texts, self.piece = [], 0

    def add(self, id: object, text: str) -> None:
        self.ids.append(id)
        self.texts.append(text)
        size = len(text.encode())
        self.size += size
        self.piece += size
        if self.piece >= self.piece_bytes:
            self.end_piece()

    def end_piece(self) -> None:
        if self.texts:
            documents, pairs, counts, links = self.pair.block(self.texts)
            if self.digest:
                documents = [
                    (*d[:4], hashlib.sha256(d[4].encode()).hexdigest() if d[4] else "") for d in documents
                ]
            self.documents += documents
            self.parts.append((pairs, counts, links))
            self.texts, self.piece = [], 0

    def end(self) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`Pair.block` of all texts."""
        self.end_piece()
        pairs, place = np.unique(np.concatenate([p for p, _, _ in self.parts]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        links, at = [], 0
        for own, n, places in self.parts:
            # Pairs go up in both, so the links of a document still do.
            now = place[at:at + len(own)]
            counts[now] += n
            links.append(now.astype("<u4")[places])
            at += len(own)
        return self.documents, pairs, counts, np.concatenate(links)


def _pressed(links: np.ndarray) -> bytes:
    """Places as steps, their bytes by significance, compressed."""
    steps = np.diff(links, prepend=links.dtype.type(0)).view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def _unpressed(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u4").ravel(), dtype="<u4")


DOCUMENT = "doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
BLOCK = "block bigint, docs array<struct<{docs}>>, pairs array<bigint>, counts array<bigint>, links binary"


def _blocks(
    docs: DataFrame, path_a: str, path_b: str, id: str, text: str, digest: bool = False
) -> DataFrame:
    kind = docs.schema[id].dataType.simpleString()
    fields = DOCUMENT.format(id=kind)
    schema = BLOCK.format(docs=fields.replace(" ", ":").replace(",:", ","))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(pair, PIECE_BYTES, digest)

        def row() -> pa.RecordBatch:
            documents, pairs, counts, links = block.end()
            columns = [pa.array(block.ids, id_type), *(
                pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*documents))
            )]
            rows = pa.StructArray.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

            def one(values: pa.Array) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), one(rows), one(pa.array(pairs, pa.int64())),
                one(pa.array(counts, pa.int64())), pa.array([_pressed(links)], pa.binary()),
            ], names=["block", "docs", "pairs", "counts", "links"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, value in zip(batch.column(0), batch.column(1)):
                block.add(name.as_py(), value.as_py())
                if block.size >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                    yield row()
                    number += 1
                    block = Block(pair, PIECE_BYTES, digest)
        if block.ids:
            yield row()

    return docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("text")).mapInArrow(blocks, schema)


def groups(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups)`` for each row of ``docs``.

    A is the byte-level BPE file ``path_a``, given a space and the text; B is the sentencepiece model
    ``path_b``, which adds that space itself. Strings of special tokens are plain text. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``: ids of A and of B between two common ends. Links are the two tokens whose
    bytes overlap. A text that is null or empty, or whose bytes a tokenizer does not keep, has no
    tokens: zeros and ''. Null and repeated ids are rows like others; an empty table gives an empty
    result; other columns are not looked at.
    """
    return _blocks(docs, path_a, path_b, id, text).select(F.inline("docs"))


def align(
    docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", digest: bool = False
) -> DataFrame:
    """The rows of :func:`groups` with ``n_best`` and ``count_sum``, counted over all of ``docs``.

    The count of a pair of ids is the number of links that hold it in all texts. ``n_best`` are the
    links whose count is the highest of their id of B, ``count_sum`` is the sum of the counts over the
    links of a document. With ``digest``, ``groups`` is its SHA-256 in lower-case hex, '' without
    tokens, and the text itself is not stored meanwhile.
    """
    blocks = stored(_blocks(docs, path_a, path_b, id, text, digest), "blocks")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "pair")).select(
        "block", "place", F.col("pair.pairs").alias("pair"), F.col("pair.counts").alias("n")
    )
    counts = stored(held.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    # At most a row for each id of B.
    best = counts.groupBy(F.expr("pair & 4294967295").alias("b")).agg(F.max("n").alias("most"))
    rated = counts.join(best, F.expr("pair & 4294967295") == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )
    # A block holds a pair once, so what is gathered is no longer than the block's own list.
    known = (
        held.select("block", "place", "pair").join(rated, "pair").groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("known"))
        .select("block", F.col("known.n").alias("n"), F.col("known.best").alias("best"))
    )
    kind = docs.schema[id].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                documents = batch.column(0)[row].values
                columns = [documents.field(k) for k in range(documents.type.num_fields)]
                n_links = columns[4].to_numpy(zero_copy_only=False)
                until = np.cumsum(n_links)
                links = _unpressed(batch.column(1)[row].as_py())
                totals = []
                for k in (2, 3):
                    values = batch.column(k)[row].values
                    each = values.to_numpy(zero_copy_only=False).astype(np.int64)[links] if values else links
                    upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                    totals.append(pa.array(upto[until] - upto[until - n_links], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*columns, totals[1], totals[0]], names=[*names, "n_best", "count_sum"]
                )

    names = [f.split()[0] for f in DOCUMENT.split(", ")]
    return (
        blocks.select("block", "docs", "links").join(known, "block", "left").select("docs", "links", "n", "best")
        .mapInArrow(sums, f"{DOCUMENT.format(id=kind)}, n_best bigint, count_sum bigint")
    )
