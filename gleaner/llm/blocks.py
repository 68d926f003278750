"""Tables of fixed size (counters, bits) that tasks fill and that are combined block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BLOCKS = 16
#: Groups of tasks whose tables are folded before those of all tasks meet.
GROUPS = 64
BLOCK = "block int, counts binary"


def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def merged_blocks(parts: DataFrame, how: np.ufunc, kind: str) -> np.ndarray:
    """The table, combined by ``how`` from rows of ``block`` and ``counts``; its size bounds what is collected.

    Rows are folded as they stream by, first in groups of the tasks that wrote them and then by block, so that a
    task holds one table whatever the number of rows.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(counts.as_py(), kind)
                if block in totals:
                    how(totals[block], x, out=totals[block])
                else:
                    totals[block] = x.copy()
        if totals:
            yield batch_of({"block": pa.array(totals, pa.int32()), "counts": pa.array([x.tobytes() for x in totals.values()], pa.binary())})

    rows = bounded_batches(parts).select("block", "counts", (F.spark_partition_id() % GROUPS).alias("group"))
    grouped = rows.repartition("block", "group").sortWithinPartitions("block", "group").select("block", "counts").mapInArrow(fold, BLOCK)
    found = grouped.repartition("block").mapInArrow(fold, BLOCK).collect()
    return np.frombuffer(b"".join(bytes(x["counts"]) for x in sorted(found, key=lambda x: x["block"])), kind)


def block_batch(table: np.ndarray, kind: str) -> pa.RecordBatch:
    """A task's table as rows for ``merged_blocks``."""
    blocks = [x.astype(kind).tobytes() for x in np.split(table, BLOCKS)]
    return batch_of({"block": pa.array(range(BLOCKS), pa.int32()), "counts": pa.array(blocks, pa.binary())})
