"""WARC archives: a writer with revisit records and a salvage reader.

The writer puts every row into a gzip member of its own. Equal payloads are stored once: the row of
smallest id is a ``response``, the others ``revisit`` it (profile identical-payload-digest).

The reader checks each record (gzip integrity, version line, header, length, payload digest). After a
failed check it searches for the next place at which a member or a version line starts a record that
passes, goes on there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch, table
from .files import Sink, opened

#: Fixed values of the formats.
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed at this size; files never hold more than one record beyond it.
FILE_BYTES = 8 << 20
#: Payloads with more than one row in so many are told to all tasks: there are fewer of them than this, some 10 MB.
#: Of any other, no more than this part of the rows meets in one task, which streams them.
HOT = 1 << 16
#: The longest header that is looked for behind a version line outside of a gzip member.
HEADER = 1 << 20
#: Bytes of a member that are unpacked at a time.
STEP = 1 << 14
DATE = "2020-01-01T00:00:00Z"

FILES = "name string, records long, bytes long"
RECORDS = (
    "kind string, file string, at long, bytes long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None) -> str:
    """The record id of a page: the same for every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(kind: str, page_id: int | None, url: str, payload: bytes, first: int | None) -> bytes:
    """One WARC record: an HTTP response, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(first), "X-Refers-To-Page-ID": str(first)}
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record, or a gap with ``reason`` and without headers."""

    at: int
    size: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at the start of ``data``, and its length; ValueError if a check fails."""
    if not VERSION.match(data):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("header without end")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, sep, value = line.decode("utf-8", "replace").partition(":")
        if not sep:
            raise ValueError("header line without colon")
        name = name.strip().lower()
        if name in headers and name != "warc-concurrent-to":  # two records' headers run into each other
            raise ValueError("header field repeated")
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or "warc-type" not in headers:
        raise ValueError("no usable length or type")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block cut short or without end mark")
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    return headers, block, stop + 4


def record_at(data: bytes, at: int) -> Found:
    """The record that starts at ``at``, in a gzip member or plain."""
    if data.startswith(GZIP, at):
        unpack, parts, end = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and end < len(data):
                piece = data[end : end + STEP]
                parts.append(unpack.decompress(piece))
                end += len(piece) - len(unpack.unused_data)
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from None
        if not unpack.eof:
            raise ValueError("gzip member cut short")
        raw = b"".join(parts)
        headers, block, size = parse(raw)
        if size != len(raw):
            raise ValueError("member holds more than its record")
        return Found(at, end - at, headers, block)
    # A plain record: its length is in its header, so only that much is copied; a header's length is bounded, so
    # that marks without a header behind them cost no more than that each.
    end = data.find(b"\r\n\r\n", at, at + HEADER)
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[at : end + 2]) if end >= 0 else None
    stop = end + 8 + int(length[1]) if length else at + 16
    headers, block, size = parse(data[at:stop])
    return Found(at, size, headers, block)


STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, which together cover it from start to end."""
    at = 0
    while at < len(data):
        try:
            found = record_at(data, at)
        except ValueError as e:
            reason, start = str(e), at
            while True:
                next_start = STARTS.search(data, at + 1)
                at = next_start.start() if next_start else len(data)
                if next_start is None:
                    yield Found(start, at - start, reason=reason)
                    return
                try:
                    found = record_at(data, at)
                    break
                except ValueError:
                    continue
            yield Found(start, at - start, reason=reason)
        yield found
        at = found.at + found.size


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the saved table of files.

    Null html is empty, a null url the empty URI; a null page_id comes after all others and never is the
    one referred to unless alone; rows with equal id and payload are all responses; payloads below
    ``least`` bytes are all responses; an empty table writes no file; further columns are not read.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = bounded_batches(pages).select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    firsts = saved(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    # Payloads that many rows share are told to every task, so that their rows need not meet in one; there are at
    # most HOT of them. Their keys in the join that follows are dealt out.
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(firsts.where(F.col("n") > max(1, total // HOT)).select("digest", F.struct("first").alias("hot")))
    spread = F.concat(F.lit("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)))
    marked = rows.join(hot, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(spread))
    rest = firsts.select(F.col("digest").alias("key"), F.struct("first").alias("own"))
    joined = marked.join(rest, "key", "left").select("page_id", "url", "payload", F.coalesce("hot", "own")["first"].alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, n, done = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for page, url, body, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                kind = "revisit" if first is not None and page != first and len(body) >= least else "response"
                sink = sink or Sink(folder, f"part-{part:06d}", ".warc.gz")
                sink.write(gzipped(record(kind, page, url or "", body, first)))
                n += 1
                if sink.size >= FILE_BYTES:
                    sink.close()
                    done.append((sink.name, n, sink.size))
                    sink, n = None, 0
        if sink:
            sink.close()
            done.append((sink.name, n, sink.size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["name", "records", "bytes"])

    return saved(joined.mapInArrow(write, FILES), "warc-files")


def fields(found: Found, name: str, keep_payload: bool) -> tuple:
    """A record's or gap's row of ``RECORDS``."""
    if found.reason:
        return ("gap", name, found.at, found.size, found.reason, *[None] * 7)
    h = found.headers
    head, _, body = found.block.partition(b"\r\n\r\n")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "revisit":
        # A revisit keeps the HTTP header of what it stands for, length included.
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
        size = int(length[1]) if length else None
    else:
        size, own = len(body), base32_sha1(body)
        if digest and own != digest:
            return ("gap", name, found.at, found.size, "payload digest differs", *[None] * 7)
        digest = own
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    return ("record", name, found.at, found.size, None, number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("x-refers-to-page-id")), size, digest, body if keep_payload else None)


def read_warc(files: DataFrame, folder: str, keep_payload: bool = True, complete: bool = False) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` from the files named in ``files``.

    A gap is a run of bytes that fails the checks, up to the next record that passes; gaps and records cover each file.
    With ``complete`` a gap, or another number of records than were written, stops the job. A file is held whole, and
    files are closed at ``FILE_BYTES``. No files give no rows.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, written in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                with opened(folder, name) as handle:
                    data = handle.read()
                rows: list[tuple] = []
                for found in salvage(data):
                    rows.append(fields(found, name, keep_payload))
                    written -= rows[-1][0] == "record"
                    if complete and rows[-1][0] == "gap":
                        raise ValueError(f"{name}: bytes {found.at} to {found.at + found.size} were not read back: {rows[-1][4]}")
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if complete and written:
                    raise ValueError(f"{name}: {written} records fewer than were written")
                if rows:
                    yield batch_of(rows)

    tasks = max(1, files.count())
    return files.select("name", "records").repartition(tasks).mapInArrow(read, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    files = write_warc(table(spark, sf_dir, "pages"), folder)
    found = read_warc(files, folder, keep_payload=False, complete=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hexes: str) -> str:
    """DuckDB SQL for the base32 form of a 40-digit hex string."""
    digit = f"(('0x' || substr({hexes}, 1 + (5 * i // 4)::INT, 2))::INT >> (3 - 5 * i % 4 + 0)::INT)"
    return f"list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({digit} & 31), 1)), 'string_agg', '')"


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) || '0' AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, {_base32_sql("h")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
