"""Token ids in shards of independent zstandard frames with a trailing seek table.

A shard holds frames of whole documents' ids (little-endian unsigned 32-bit), then two skippable frames:
a document index (doc_id, token count and frame of each document), and the seek table of the zstandard
seekable format, with compressed size, size and checksum (low half of xxh64) of every frame. A reader
finds the tables at the file's end and decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch, table
from .files import Sink, opened
from .tokens import encoder, portions

VOCABULARY = "word_bpe_49k.json"
END = 2
#: A frame is closed at this many bytes of ids; a longer document has a frame of its own size.
FRAME_BYTES = 1 << 16
#: A shard is closed at this many bytes of ids or documents; a task writes as many shards as it needs.
SHARD_BYTES = 1 << 26
SHARD_DOCS = 1 << 18
#: Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

#: Text and rows that a task sorts and encodes, about.
TASK_BYTES = 1 << 28
TASK_DOCS = 1 << 20

SHARDS = "shard long, name string, docs long, tokens long, bytes long"


class ShardWriter:
    """Writes one shard: ``add`` documents in order, then ``close``."""

    def __init__(self, folder: str, shard: int):
        self.sink = Sink(folder, f"tokens-{shard:012d}", ".zst")
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4, len(self.frames)))
        self.tokens += len(ids) // 4
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            packed = self.compressor.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.held = [], 0

    def close(self) -> None:
        self.flush()
        ids = np.array([0 if d is None else d for d, _, _ in self.docs], "<i8")
        rest = np.array([(n, f, d is None) for d, n, f in self.docs], "<u4").reshape(-1, 3)
        index = self.compressor.compress(struct.pack("<I", len(ids)) + ids.tobytes() + rest.tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(index)))
        entries = b"".join(struct.pack("<III", *x) for x in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + len(foot)) + entries + foot)
        self.sink.close()


class ShardReader:
    """Reads documents of one shard; only the frames that hold them are decompressed."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        entries = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.checks = entries[:, 0], entries[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        tail = size - 9 - 12 * n - 8
        length = struct.unpack("<I", self.at(tail - 4, 4))[0]
        raw = zstandard.ZstdDecompressor().decompress(self.at(tail - 4 - length, length))
        docs = struct.unpack("<I", raw[:4])[0]
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 4)
        rest = np.frombuffer(raw, "<u4", 3 * docs, 4 + 8 * docs).reshape(-1, 3).astype(np.int64)
        self.counts, self.frame_of, self.null = rest[:, 0], rest[:, 1], rest[:, 2] > 0
        self.decompressor = zstandard.ZstdDecompressor()

    def at(self, start: int, n: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(n)

    def frame(self, k: int) -> bytes:
        raw = self.decompressor.decompress(self.at(int(self.starts[k]), int(self.sizes[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k}: its checksum differs")
        return raw

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, place in the shard and ids of all documents, or of those at the places ``wanted``."""
        places = np.arange(len(self.doc_ids)) if wanted is None else np.sort(wanted)
        before = np.concatenate([[0], np.cumsum(self.counts)])
        held, raw, first = -1, b"", 0
        for i in places.tolist():
            if (k := int(self.frame_of[i])) != held:
                held, raw, first = k, self.frame(k), int(before[np.searchsorted(self.frame_of, k)])
            a = 4 * (int(before[i]) - first)
            yield None if self.null[i] else int(self.doc_ids[i]), int(before[i]), raw[a : a + 4 * int(self.counts[i])]


def needed_tasks(docs: int, size: int) -> int:
    """Tasks that so many documents of so many bytes of text ask for."""
    return max(1, -(-docs // TASK_DOCS), -(-size // TASK_BYTES))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Writes every document's ids to shards in ``folder``; returns the saved table of shards.

    Documents are range-partitioned by doc_id and row, so shards ascend and neither a hot source nor one doc_id
    repeated goes to one task; the number of tasks follows the bytes and rows of the table where they ask for more than
    the session's; shards are numbered by task and place in it. Null texts are empty; very long texts are
    one frame; null ids come first; documents with equal ids follow in the order of the table's rows; an empty table
    writes no shard; further columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, shard = encoder(vocabulary, keeps_spaces=False), np.uint32(end).tobytes(), TaskContext.get().partitionId() << 24
        writer = None

        def row() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"shard": [shard], "name": [writer.sink.name], "docs": [len(writer.docs)], "tokens": [writer.tokens], "bytes": [writer.sink.size]})

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for part in portions(texts):
                for doc, ids in zip(doc_ids[part], encode.encode(texts[part]), strict=True):
                    writer = writer or ShardWriter(folder, shard)
                    writer.add(doc, ids + last)
                    if 4 * writer.tokens >= SHARD_BYTES or len(writer.docs) >= SHARD_DOCS:
                        yield row()
                        writer, shard = None, shard + 1
        if writer:
            yield row()

    numbered = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = needed_tasks(n, size)
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = numbered.repartitionByRange(tasks, "doc_id", "row") if tasks > usual else numbered.repartitionByRange("doc_id", "row")
    ordered = spread.sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return saved(ordered.mapInArrow(write, SHARDS), "token-shards")


def read_tokens(shards: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """Documents of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 and ids.

    A shard whose tables or frames fail their checks stops the job; no shards give no rows. Only the rows of shards,
    of which there is one for ``SHARD_BYTES`` of ids, are summed up in one task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(folder, name) as handle:
                    rows: list[tuple] = []
                    for doc, start, ids in ShardReader(handle).documents():
                        rows.append((doc, first + start, len(ids) // 4, zlib.crc32(ids), ids)[: 5 if keep_ids else 4])
                        if len(rows) == 2000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names[: len(rows[0])])

    tasks = max(1, shards.count())
    return offsets.select("name", "first").repartition(tasks).mapInArrow(read, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    shards = write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(shards, folder, keep_ids=False)
