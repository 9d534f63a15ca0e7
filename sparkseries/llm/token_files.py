"""Token ids in binary shard files, each document compressed by itself with one shared dictionary.

A folder of token files holds

* ``shards/*.bin``: a header (:data:`MAGIC`, bytes of an id, SHA-256 of the dictionary) and then a
  zstandard frame for each document: its ids, little-endian, in ascending order of the documents;
* ``index``: a Parquet row for each document, sorted by id, with its shard, the place of its frame
  and the number of ids before it in the shard;
* ``starts``: a row for each shard with its file and the number of ids in the shards before it;
* ``meta``: one row with the dictionary, its SHA-256 and the bytes of an id.

A document is read by its index row and one frame, whatever its shard holds beside it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import join_measured
from .common import stored, text_of
from .packing import ByteBpe

MAGIC = b"tokshard"
HEADER_BYTES = len(MAGIC) + 1 + 32
# Frames that lie side by side are read together up to this size, and results are given out in such pieces.
READ_BYTES = 4 << 20


def _dictionary(data: bytes, trained: bool) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def train(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """A dictionary of at most ``size`` bytes, and whether it is a trained one.

    Samples that are too few to train on are themselves the dictionary.
    """
    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[:size], False


def sample_texts(docs: DataFrame, text: str, samples: int, sample_bytes: int) -> DataFrame:
    """At most ``samples`` different texts of at most ``sample_bytes`` bytes, those of the least hash."""
    texts = docs.select(text_of(text).alias("text")).where(
        f"octet_length(text) between 1 and {sample_bytes}"
    ).select("text", F.xxhash64("text").alias("h"))
    least = texts.select("h").distinct().orderBy("h").limit(samples)
    return texts.join(F.broadcast(least), "h").dropDuplicates(["h"]).select("text")


def write_token_files(
    docs: DataFrame, path: str, folder: str, id: str = "doc_id", text: str = "text", end_id: int = 2,
    shard_tokens: int = 1 << 26, samples: int = 2000, sample_bytes: int = 8192,
    dictionary_bytes: int = 1 << 16, level: int = 3,
) -> TokenFiles:
    """Write the ids of each row of ``docs``, and ``end_id`` after them, into ``folder``.

    ``path`` is a byte-level BPE vocabulary file. A null text is an empty one: ``end_id`` alone.
    Documents are stored in ascending order of their id, null first; rows that share an id are all
    stored, in the order of a hash of their frames. The dictionary is trained on ``samples`` short
    texts, a bound that also holds for what the driver sees; every text is stored, whole, at any
    length. Other columns are not looked at; an empty table gives an empty folder that can be read.

    A task that is run again writes a file of another name; only the files that the index names count.
    """
    spark = docs.sparkSession

    def encoded(rows: DataFrame, data: bytes = b"", trained: bool = False, wide: int = 0) -> DataFrame:
        """``(doc_id, n, frame)``; without ``wide``, serialised ids that are not compressed."""
        def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer = ByteBpe(path)
            press = zstandard.ZstdCompressor(
                level=level, dict_data=_dictionary(data, trained), write_checksum=True
            ).compress if wide else bytes
            kind = f"<u{wide or 4}"
            for batch in batches:
                counts, out, held = [], [], 0
                done = 0
                for place, value in enumerate(batch.column(1)):
                    ids = np.append(tokenizer.ids(value.as_py()), np.uint32(end_id)).astype(kind)
                    counts.append(len(ids))
                    out.append(press(ids.tobytes()))
                    held += len(out[-1])
                    if held >= READ_BYTES or place == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).slice(done, len(out)), pa.array(counts, pa.int64()),
                            pa.array(out, pa.binary()),
                        ], names=["doc_id", "n", "frame"])
                        counts, out, held, done = [], [], 0, place + 1

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(frames, f"doc_id {kind}, n bigint, frame binary")

    sampled = sample_texts(docs, text, samples, sample_bytes).select(F.lit(0).alias("doc_id"), "text")
    taken = sorted(bytes(r.frame) for r in encoded(sampled).select("frame").collect())
    largest = _largest_id(path, end_id)
    wide = 2 if largest < 1 << 16 else 4
    data, trained = train([np.frombuffer(t, "<u4").astype(f"<u{wide}").tobytes() for t in taken], dictionary_bytes)
    digest = hashlib.sha256(data).digest()

    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("text"))
    staged = stored(
        encoded(rows, data, trained, wide).withColumn("tie", F.xxhash64("frame"))
        .withColumn("row", F.monotonically_increasing_id()),
        "frames",
    )
    total = staged.agg(F.sum("n")).first()[0] or 0
    shards = max(-(-total // shard_tokens), spark.sparkContext.defaultParallelism)
    header = MAGIC + bytes([wide]) + digest

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        place, before = HEADER_BYTES, 0
        out = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                system, root = FileSystem.from_uri(folder)
                system.create_dir(f"{root}/shards", recursive=True)
                name = f"shards/{shard:08d}-{uuid.uuid4().hex}.bin"
                out = system.open_output_stream(f"{root}/{name}")
                out.write(header)
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, frame in enumerate(batch.column(2)):
                sizes[i] = out.write(frame.as_buffer())
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            ends, upto = place + np.cumsum(sizes), before + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(batch.num_rows, shard, np.int64)),
                pa.array([name] * batch.num_rows), pa.array(ends - sizes), pa.array(sizes),
                pa.array(upto - counts), batch.column(1),
            ], names=INDEX)
            place, before = int(ends[-1]), int(upto[-1])
        if out is not None:
            out.close()

    kind = docs.schema[id].dataType.simpleString()
    (
        staged.repartitionByRange(shards, "doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "n", "frame")
        .mapInArrow(write, INDEX_SCHEMA.format(id=kind)).write.parquet(f"{folder}/index")
    )
    # One row for each shard, so that a window over all of them stays small.
    counted = spark.read.parquet(f"{folder}/index").groupBy("shard", "file").agg(F.sum("n_ids").alias("ids"))
    below = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted.select(
        "shard", "file", "ids", F.coalesce(F.sum("ids").over(below), F.lit(0)).alias("shard_start")
    ).write.parquet(f"{folder}/starts")
    spark.createDataFrame(
        [(bytearray(data), trained, digest.hex(), wide)], META
    ).coalesce(1).write.parquet(f"{folder}/meta")
    return TokenFiles(spark, folder)


INDEX = ["doc_id", "shard", "file", "offset", "bytes", "first", "n_ids"]
INDEX_SCHEMA = (
    "doc_id {id}, shard bigint, file string, offset bigint, bytes bigint, first bigint, n_ids bigint"
)
META = "dictionary binary, trained boolean, dictionary_sha256 string, id_bytes int"


def _largest_id(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


class TokenFiles:
    """A folder that :func:`write_token_files` wrote."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        meta = spark.read.schema(META).parquet(f"{folder}/meta").first()
        self.dictionary, self.trained = bytes(meta.dictionary), meta.trained
        self.id_bytes = meta.id_bytes
        self.digest = hashlib.sha256(self.dictionary).digest()
        if self.digest.hex() != meta.dictionary_sha256:
            raise ValueError(f"the dictionary of {folder} is damaged")

    def index(self) -> DataFrame:
        """A row for each document with ``start``, the ids of all documents before it."""
        index = self.spark.read.parquet(f"{self.folder}/index")
        starts = self.spark.read.parquet(f"{self.folder}/starts").select("shard", "shard_start")
        return join_measured(index, starts, ["shard"]).withColumn("start", F.expr("shard_start + first"))

    def read(self, where: Column | None = None, form: str = "array") -> DataFrame:
        """``(doc_id, start, ids)`` of the documents whose index rows satisfy ``where``, or of all.

        ``ids`` is an array, or with ``form="bytes"`` the same as little-endian 32-bit numbers. A
        condition on ``doc_id`` reaches the index, which is sorted by it; only the frames of the
        documents found are read. A shard with another dictionary than this folder's is refused.
        """
        index = self.index() if where is None else self.index().where(where)
        rows = index.select("doc_id", "start", "file", "offset", "bytes")
        if where is None:
            parts = max(
                self.spark.sparkContext.defaultParallelism,
                self.spark.read.parquet(f"{self.folder}/starts").count(),
            )
            rows = rows.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
        kind = "array<bigint>" if form == "array" else "binary"
        id_kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(
            _reader(self.folder, self.dictionary, self.trained, self.id_bytes, form),
            f"doc_id {id_kind}, start bigint, ids {kind}",
        )


def _reader(folder: str, data: bytes, trained: bool, wide: int, form: str):
    """The function that turns index rows into ids, frames side by side read at once."""
    header = MAGIC + bytes([wide]) + hashlib.sha256(data).digest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(folder)
        unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(data, trained)).decompress
        opened, source = None, None
        for batch in batches:
            files = batch.column(2).to_pylist()
            offsets, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            first = 0
            while first < len(files):
                last = first + 1
                while (
                    last < len(files) and files[last] == files[first]
                    and offsets[last] == offsets[last - 1] + sizes[last - 1]
                    and offsets[last] + sizes[last] - offsets[first] <= READ_BYTES
                ):
                    last += 1
                if files[first] != opened:
                    if source is not None:
                        source.close()
                    opened = files[first]
                    source = system.open_input_file(f"{root}/{opened}")
                    if source.read_at(HEADER_BYTES, 0) != header:
                        raise ValueError(f"{opened} was written with another dictionary")
                base = int(offsets[first])
                block = source.read_at(int(offsets[last - 1] + sizes[last - 1]) - base, base)
                held, begin, size = [], first, 0
                for i in range(first, last):
                    at = int(offsets[i]) - base
                    ids = np.frombuffer(unpress(block[at:at + int(sizes[i])]), f"<u{wide}")
                    held.append(ids.astype("<u4"))
                    size += held[-1].nbytes
                    if size >= READ_BYTES or i == last - 1:
                        yield _rows(batch.slice(begin, len(held)), held, form)
                        held, begin, size = [], i + 1, 0
                first = last
        if source is not None:
            source.close()

    return read


def _rows(batch: pa.RecordBatch, held: list[np.ndarray], form: str) -> pa.RecordBatch:
    if form == "array":
        ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, np.concatenate(held).astype(np.int64))
    else:
        ids = pa.array([h.tobytes() for h in held], pa.binary())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), ids], names=["doc_id", "start", "ids"]
    )
