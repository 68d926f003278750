"""JSON-lines logs as a sink: ``df.write.format("jsonl_log").mode("append").save(folder)``, in batch and as a stream.

Tasks write files aside and tell their names; the driver moves them to the folder once all tasks are done. A task that
fails leaves no line there, a stream's batch that is run again replaces what an interrupted commit had moved, and one that was
committed is not added twice. Any reader of JSON lines reads the folder: names with a leading underscore are not part of it.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import storage

ASIDE, COMMITS = "_aside", "_commits"
LINES = 1000


def plain(x: Any) -> Any:
    """What JSON has no form for: times in UTC to the second, decimals as numbers, bytes as base64."""
    if isinstance(x, datetime):
        return x.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, Decimal):
        return float(x)
    return base64.b64encode(x).decode()


def line(row: Row) -> str:
    """A row as a line; fields that are null are left out, as Spark's own JSON does."""
    return json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, default=plain, ensure_ascii=False)


@dataclass
class Aside(WriterCommitMessage):
    """The file that a task wrote, if it had a row."""

    name: str | None


class LogWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Aside:
        store, path = storage.filesystem(self.folder)
        name = None
        out, held = None, []
        for row in iterator:
            if out is None:
                name = f"{uuid.uuid4().hex}.jsonl"
                store.create_dir(f"{path}/{ASIDE}", recursive=True)
                out = store.open_output_stream(f"{path}/{ASIDE}/{name}", compression=None)
            held.append(line(row) + "\n")
            if len(held) == LINES:
                out.write("".join(held).encode())
                held = []
        if out is not None:
            out.write("".join(held).encode())
            out.close()
        return Aside(name)

    def moved(self, messages: list[Aside | None], prefix: str) -> None:
        store, path = storage.filesystem(self.folder)
        for k, m in enumerate(m for m in messages if m and m.name):
            store.move(f"{path}/{ASIDE}/{m.name}", f"{path}/{prefix}-{k:05d}.jsonl")

    def dropped(self, messages: list[Aside | None]) -> None:
        store, path = storage.filesystem(self.folder)
        for m in messages:
            if m and m.name and store.get_file_info(f"{path}/{ASIDE}/{m.name}").type == fs.FileType.File:
                store.delete_file(f"{path}/{ASIDE}/{m.name}")

    def commit(self, messages: list[Aside | None]) -> None:
        # Names sort by the time of the commit, so a listing has them in order.
        self.moved(messages, f"{datetime.now(UTC):%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}")

    def abort(self, messages: list[Aside | None]) -> None:
        self.dropped(messages)


class LogStreamWriter(LogWriter, DataSourceStreamWriter):
    def commit(self, messages: list[Aside | None], batchId: int) -> None:
        store, path = storage.filesystem(self.folder)
        prefix = f"batch-{batchId:012d}"
        if f"{prefix}" in storage.names(f"{self.folder}/{COMMITS}"):
            self.dropped(messages)
            return
        for name in storage.names(self.folder):
            if name.startswith(f"{prefix}-"):
                store.delete_file(f"{path}/{name}")
        self.moved(messages, prefix)
        storage.write_bytes(f"{self.folder}/{COMMITS}/{prefix}", b"")

    def abort(self, messages: list[Aside | None], batchId: int) -> None:
        self.dropped(messages)


class JsonLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_log"

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only ever appended to")
        return LogWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options["path"])


def append_log(rows: DataFrame, folder: str) -> None:
    rows.sparkSession.dataSource.register(JsonLog)
    rows.write.format("jsonl_log").mode("append").save(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Lines of a log as rows; a line that is no JSON fails the job, a folder that does not exist is empty."""
    if not storage.names(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
