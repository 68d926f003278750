"""Media columns: texts as FLAC files in a table, read back as verified PCM blocks with sample offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac
from .blocks import batch_of
from .common import bounded_batches, saved, table

#: Bytes of samples that are coded side by side.
PORTION = 1 << 21
MEDIA = "doc_id long, n_bytes long, media binary"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks array<struct<first_sample: long, pcm: binary>>"


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8, filled up with bytes 255 to a positive multiple of the block."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % flac.BLOCK or (0 if raw else flac.BLOCK))


def slices(sizes: list[int], most: int = PORTION) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media for every row of ``docs`` (doc_id, text).

    A null text is empty; an empty text is one block of filling; very long texts are coded whole, in portions of
    many frames; repeated rows give equal files; an empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices([len(x or "") for x in texts]):
                sizes = [len((x or "").encode("utf-8", "surrogatepass")) for x in texts[part]]
                media = flac.encode([payload_of(x) for x in texts[part]])
                yield batch_of({"doc_id": ids[part.start : part.stop], "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MEDIA)


def feature(payload: bytes) -> str:
    """Mean, energy and sign changes of the samples, from whole-number sums."""
    x = flac.SAMPLE_OF[np.frombuffer(payload, np.uint8)].astype(np.int64)
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.sum() / len(x):.6f};energy={(x * x).sum() / len(x):.6f};crossings={turns}"


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[bytes], list[bytes]]]:
    """Ids, text sizes, files and payloads of media rows, by portion."""
    for batch in batches:
        files = batch.column(2).to_pylist()
        for part in slices([len(x) for x in files]):
            rows = batch[part.start : part.stop]
            yield rows.column(0), rows.column(1), files[part], flac.decode(files[part])


def block_lists(payloads: list[bytes]) -> pa.ListArray:
    """Each payload's blocks of 576 samples with the number of their first sample."""
    n = np.array([len(p) // flac.BLOCK for p in payloads])
    total = int(n.sum())
    offsets = pa.array(np.arange(total + 1, dtype=np.int32) * flac.BLOCK)
    pcm = pa.Array.from_buffers(pa.binary(), total, [None, offsets.buffers()[1], pa.py_buffer(b"".join(payloads))])
    first = (np.arange(total) - np.repeat(np.cumsum(n) - n, n)) * flac.BLOCK
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(first, pa.int64()), pcm], ["first_sample", "pcm"]))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Digests and features of every file from its decoded samples, and these as blocks with seekable sample offsets.

    All frame checksums and each file's MD5 are verified first; a damaged file stops the job. Files of any length
    are decoded whole; repeated rows give equal blocks; an empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, files, payloads in decoded(batches):
            yield batch_of(
                {
                    "doc_id": ids,
                    "n_bytes": sizes,
                    "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array(map(len, files), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    "feature": pa.array(map(feature, payloads), pa.string()),
                    "blocks": block_lists(payloads),
                }
            )

    return bounded_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FLAC files are a saved table; the result carries what is read back from it, blocks included."""
    return pcm_blocks(saved(encode_documents(table(spark, sf_dir, "documents")), "media"))
