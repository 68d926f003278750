"""Tables that a helper makes of files: its rows leave the task in batches, whatever number of files they are of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of files with so many characters, or so many rows, leave a task together.
CHARACTERS, ROWS = 1 << 20, 4096


def batches(rows_of: Callable[[str, str], Iterator[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What turns batches of files (path, content) into batches of the rows that ``rows_of`` makes of each."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], kinds.names)

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for given in files:
            for path, source in zip(given["path"].to_pylist(), given["content"].to_pylist(), strict=True):
                if source is None:
                    continue
                size += len(source)
                for row in rows_of(path, source):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows, size = [], 0
                if rows and size >= CHARACTERS:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def tabled(files: DataFrame, rows_of: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of ``schema`` that ``rows_of`` makes of path and content of each of ``files``; files without content have none."""
    # Where content is an expression, a condition on it would have Spark work it out twice.
    own = files.select("path", "content")
    own.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return own.mapInArrow(batches(rows_of, schema), schema)
