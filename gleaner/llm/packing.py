"""Packing: documents into sequences of at most ``capacity`` tokens.

A document's ids are cut into full windows and a rest; the rest, in pieces of at most ``piece`` ids, is
packed by Karmarkar-Karp multiway differencing. Each piece starts as a partial partition with one filled
window; the two partial partitions of largest imbalance are merged, the fullest windows of one with the
emptiest of the other, until one remains, whose windows are nearly equal. If a window exceeds the
capacity, one more window is used and the differencing repeated.

Pieces are dealt by a hash of their row into groups of about ``WINDOWS`` windows, whose number follows
the total, so a group's size does not grow with the input, nor with one source or document.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, table
from .tokens import encoder, portions

CAPACITY = 1024
PIECE = 256
WINDOWS = 128
#: Pieces of a group, on average at most: tables of very short documents have more groups of fewer windows.
GROUP_PIECES = 4096
VOCABULARY = "byte_bpe_50k.json"
END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_uid long"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece after multiway differencing into ``windows`` windows."""
    n = len(sizes)
    after = np.full(n, -1)
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        total, head = np.zeros(windows, np.int64), np.full(windows, -1)
        total[0], head[0] = sizes[i], i
        heap.append((-int(sizes[i]) if windows > 1 else 0, int(i), total, head, head.copy()))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, at, ah, al = heapq.heappop(heap)
        _, b, bt, bh, bl = heapq.heappop(heap)
        # Totals fall along at and bt; the largest of one meets the smallest of the other.
        bt, bh, bl = bt[::-1], bh[::-1], bl[::-1]
        both = (ah >= 0) & (bh >= 0)
        after[al[both]] = bh[both]
        total = at + bt
        head, last = np.where(ah >= 0, ah, bh), np.where(bh >= 0, bl, al)
        order = np.argsort(-total, kind="stable")
        total = total[order]
        heapq.heappush(heap, (int(total[-1] - total[0]), min(a, b), total, head[order], last[order]))
    window = np.zeros(n, np.int64)
    for w, i in enumerate(heap[0][3] if heap else ()):
        while i >= 0:
            window[i] = w
            i = after[i]
    return window


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of pieces no longer than ``capacity``; their number rises while one is too full."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, windows)
        most = np.bincount(found, sizes, windows).max() if len(sizes) else 0
        if most <= capacity:
            return found
        windows += 1


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> np.ndarray:
    """Starts of a document's pieces and its length: full windows, then near-equal parts of the rest."""
    full = n // capacity * capacity
    parts = -(-(n - full) // piece)
    return np.concatenate([np.arange(0, full, capacity), full + np.arange(parts) * (n - full) // max(parts, 1), [n]])


def tokenized_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, piece: int = PIECE, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``PIECES`` and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keeps_spaces=True)
        uid, last = TaskContext.get().partitionId() << 40, np.uint32(end).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for part in portions(texts):
                rows: list[tuple] = []
                for doc, ids in zip(doc_ids[part], encode.encode(texts[part]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    at = cuts(n, capacity, piece).tolist()
                    for a, b in zip(at, at[1:], strict=False):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc, a, b - a, zlib.crc32(own), n, uid, own) if keep_ids else (doc, a, b - a, zlib.crc32(own), n, uid))
                        uid += 1
                kinds = [*[pa.int64()] * 6, *[pa.binary()] * keep_ids]
                names = [*(x.split()[0] for x in PIECES.split(", ")), *["ids"] * keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a saved table of pieces, each no longer than ``capacity``.

    Pieces are dealt to groups by a hash of ``piece_uid``, which numbers the rows of the saved table's tasks: another
    partitioning of the input gives other sequences of the same kind. Ties of size go by ``piece_uid``; an empty table
    gives no rows; further columns are kept, but for the group's own.
    """
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    sums = rest.agg(F.sum("length").alias("ids"), F.count("*").alias("pieces")).first()
    groups = max(1, round((sums["ids"] or 0) / (capacity * windows)), -(-sums["pieces"] // GROUP_PIECES))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_uid", ignore_index=True)
        window = pack_group(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (group["_g"].to_numpy() << 21) + 2 * window
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns="_g")

    out = f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long"
    dealt = rest.withColumn("_g", F.pmod(F.xxhash64("piece_uid"), F.lit(groups)))
    alone = full.withColumns({"sequence_id": F.col("piece_uid") * 2 + 1, "offset": F.lit(0).cast("long")})
    tasks = max(1, min(groups // 4, 1 << 14))  # few groups a task: their work is far above their bytes
    return dealt.repartition(tasks, "_g").groupBy("_g").applyInPandas(pack, out).unionByName(alone)


def pack(docs: DataFrame, keep_ids: bool = True, **how) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``CAPACITY`` ids.

    Columns: ``PIECES`` without ``piece_uid``, ``ids`` if kept, ``sequence_id``, ``offset``. A null text is
    empty, and an empty text is its end id alone; very long texts are cut into windows; a null doc_id stays null; rows repeated are packed each
    for itself; an empty table gives no rows; further columns of ``docs`` are not read.
    """
    pieces = saved(tokenized_pieces(docs, keep_ids=keep_ids, **how), "pieces")
    return pack_pieces(pieces).drop("piece_uid")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with their digests; the ids themselves are dropped where they are cut."""
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
