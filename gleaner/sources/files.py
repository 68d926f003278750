"""Source trees as tables of files, read by the executors in batches of paths."""

from __future__ import annotations

import json
import operator
import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from .. import storage
from .config import fits

# Extensions that are read, folders and names that are not.
EXTENSIONS = (".go", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".pyi", ".rs", ".sh", ".bash", ".toml", ".yaml", ".yml", ".json", ".env")
FOLDERS = (".git", "vendor", "node_modules", "testdata", "__pycache__", ".venv", "dist", "build")
NAMES = ("*.min.js", "*.bundle.js", "*.pyc")
#: Names that are read for what they say about a file beside them.
NEIGHBOURS = (".gitignore", ".env.example")
#: Extensions of files whose changes are followed.
WATCHED = (".go", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".sh", ".bash", ".toml", ".yaml", ".yml", ".json", ".env")
PER_PARTITION = 256
#: Files of an event log after which they become one.
KEPT_LOGS = 64


def suffix(name: str) -> str:
    return name[name.rindex(".") :] if "." in name else ""


def walk(root: str, folders=FOLDERS, names=NAMES) -> list[str]:
    """Paths below ``root`` in lexical order; hidden folders and those of ``folders`` are left out, the root too.

    ``names`` are patterns of base names that are left out; a malformed one is an error. A ``root`` that is a file is
    read whatever its name.
    """
    if os.path.isfile(root):
        return [root]
    fits("", [*names])
    top = os.path.basename(os.path.normpath(root))
    if root != "." and (top in folders or top.startswith(".")):
        return []
    out = []
    for at, inner, found in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in folders and not d.startswith("."))
        out += [os.path.join(at, f) for f in found if (suffix(f) in EXTENSIONS or f in NEIGHBOURS) and not fits(f, [*names])]
    return sorted(out)


def listed(options: dict[str, str], key: str) -> tuple[str, ...]:
    return tuple(filter(None, options.get(key, "").split(",")))


def read_text(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


class PathBatch(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


#: Tests that the reader takes over from Spark: each is one on a column's value.
TESTS: dict[type[Filter], Callable[[Any, Any], bool]] = {
    EqualTo: operator.eq, EqualNullSafe: operator.eq, In: lambda x, given: x in given, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains,
}
#: Columns known before a file is opened, from its path, time of writing and size.
KNOWN: dict[tuple[str, ...], Callable[[tuple[str, int, int]], Any]] = {("path",): lambda f: f[0], ("ext",): lambda f: suffix(os.path.basename(f[0])), ("mtime_ns",): lambda f: f[1], ("size",): lambda f: f[2]}


def as_test(given: Filter) -> Callable[[tuple[str, int, int]], bool] | None:
    """A filter as a test on a file that is not open yet, or none where the reader does not know it."""
    if isinstance(given, Not):
        inner = as_test(given.child)
        return None if inner is None else lambda f: not inner(f)
    if isinstance(given, IsNotNull) and given.attribute in KNOWN:
        return lambda f: True
    if type(given) not in TESTS or given.attribute not in KNOWN:
        return None
    value, test = KNOWN[given.attribute], TESTS[type(given)]
    wanted = set(given.value) if isinstance(given, In) else given.value
    if wanted is None or isinstance(wanted, set) and None in wanted:
        return None
    return lambda f: test(value(f), wanted)


class FileReader(DataSourceReader):
    """Walks once on the driver; a task gets the files of its own batch alone, after the filters on what is known of them."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tests: list[Callable[[tuple[str, int, int]], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for given in filters:
            if (test := as_test(given)) is None:
                yield given
            else:
                self.tests.append(test)

    def partitions(self) -> list[PathBatch]:
        paths = walk(self.options["path"], FOLDERS + listed(self.options, "exclude"), NAMES + listed(self.options, "patterns"))
        files = []
        for path in paths:
            try:
                at = os.stat(path)
            except FileNotFoundError:
                at = os.lstat(path)  # a link to nothing: known, but not to be read
            files.append((path, at.st_mtime_ns, at.st_size))
        files = [f for f in files if all(test(f) for test in self.tests)]
        return [PathBatch(files[i : i + PER_PARTITION]) for i in range(0, len(files), PER_PARTITION)]

    def read(self, partition: PathBatch) -> Iterator[tuple]:
        whole = self.options.get("content", "true") == "true"
        for path, at, size in getattr(partition, "files", None) or []:
            row = path, suffix(os.path.basename(path)), at, size
            yield (*row, read_text(path)) if whole else row


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: unlike the file sources it also reads names with a leading dot or underscore.

    Filters on path, ext, mtime_ns and size act before a file is opened (where ``spark.sql.python.filterPushdown.enabled``
    is set). Spark does not tell Python sources which columns are wanted: with the option ``content`` false the table has no contents
    and no file is opened. Paths are those of a file system that driver and executors mount alike.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, ext string, mtime_ns long, size long" + (", content string" if self.options.get("content", "true") == "true" else "")

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))


def tree(spark: SparkSession, root: str, exclude: str, patterns: str, content: bool) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("exclude", exclude).option("patterns", patterns).option("content", str(content).lower()).load(root)


def read_tree(spark: SparkSession, root: str, exclude: str = "", patterns: str = "") -> DataFrame:
    """Files below ``root`` (path, ext, mtime_ns, size, content) without folders in the comma list ``exclude`` and names fitting ``patterns``."""
    return tree(spark, root, exclude, patterns, True)


def write_tree(files: DataFrame, root: str) -> int:
    """Writes ``files`` (path below ``root``, content) as a source tree in the tasks; the number of files written.

    Null contents are empty files. A path that leaves ``root`` fails the job; of rows with one path the least content stays, so
    a task that runs again writes the same. ``root`` is a path or URI that driver and executors share.
    """
    one = files.where("path is not null").groupBy("path").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if os.path.isabs(path) or os.path.normpath(path).split(os.sep)[0] == "..":
                    raise ValueError(f"{path} lies outside of the tree")
                storage.write_bytes(f"{root.rstrip('/')}/{os.path.normpath(path)}", content.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return one.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def list_tree(spark: SparkSession, root: str, exclude: str = "", patterns: str = "") -> DataFrame:
    """``read_tree`` without contents: no file is opened."""
    return tree(spark, root, exclude, patterns, False)


#: Entries that a task lists before it hands the folders that are left back to be dealt out anew.
PER_LISTING = 100_000


def walked(spark: SparkSession, root: str, exclude: str = "", patterns: str = "", most: int = PER_LISTING) -> DataFrame:
    """``list_tree`` for large trees: the tasks list the folders, in rounds.

    A task lists its folders and those within them until it has seen ``most`` entries; folders that are left are dealt out
    over all tasks in the next round, so a deep or lopsided tree does not stay with one of them, and a small one takes one job.
    What a round found is written. One folder's entries are always listed by one task, as a stream. Folders that cannot be
    read are passed over, as ``list_tree`` does.
    """
    folders, names = (*FOLDERS, *filter(None, exclude.split(","))), [*NAMES, *filter(None, patterns.split(","))]
    if not os.path.isdir(root):
        return list_tree(spark, root, exclude, patterns)
    fits("", names)
    top = os.path.basename(os.path.normpath(root))
    schema = pa.schema([("folder", pa.string()), ("path", pa.string()), ("ext", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, seen, rows = [f for b in batches for f in b["folder"].to_pylist()], 0, []
        while left and seen < most:
            here = left.pop()
            try:
                entries = os.scandir(here)
            except OSError:
                continue
            with entries:
                for e in entries:
                    seen += 1
                    if e.is_dir():
                        if e.name not in folders and not e.name.startswith(".") and not e.is_symlink():
                            left.append(e.path)
                    elif (suffix(e.name) in EXTENSIONS or e.name in NEIGHBOURS) and not fits(e.name, names):
                        try:
                            at = e.stat()
                        except FileNotFoundError:
                            at = e.stat(follow_symlinks=False)
                        rows.append((None, e.path, suffix(e.name), at.st_mtime_ns, at.st_size))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        rows += [(f, None, None, None, None) for f in left]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kind = "folder string, path string, ext string, mtime_ns long, size long"
    start = [] if root != "." and (top in folders or top.startswith(".")) else [(root,)]
    level, found = spark.createDataFrame(start, "folder string"), None
    tasks = spark.sparkContext.defaultParallelism
    while found is None or not level.isEmpty():
        dealt = level.repartition(tasks, F.xxhash64("folder")) if found is not None else level.coalesce(1)
        out = storage.saved(dealt.mapInArrow(run, kind), "listing")
        files = out.where("folder is null").drop("folder")
        level, found = out.where("folder is not null").select("folder"), files if found is None else found.unionByName(files)
    return found


def with_contents(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``files`` (path, ...) with their contents, read by the executors; a file that is gone by then has a null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PER_PARTITION):
                some, texts = batch.slice(at, PER_PARTITION), []
                for path in some.column("path").to_pylist():
                    try:
                        texts.append(read_text(path))
                    except FileNotFoundError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, "content"])

    dealt = files.repartition(tasks, "path") if tasks else files
    return dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content string")


class EventPart(InputPartition):
    def __init__(self, entries: list[tuple[str, int]]):
        self.entries = entries


class EventReader(DataSourceStreamReader):
    """Files of one folder (not below it) that are written from now on: path, time of writing and content.

    The driver keeps a log beside the stream's checkpoint: what the folder held when the stream first started, then an entry
    for each write it sees. An offset is a place in the log, so a stream that starts again finds what was written while it was
    off, and tasks read the contents of their own entries. What is removed or renamed away gives no event; a file that
    vanishes before it is read gives none either, and one that is written again before that gives its later content twice.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.log = options["path"], options["log"]
        self.per_part = int(options.get("files_per_partition", PER_PARTITION))
        self.end, self.seen, self.entries = 0, {}, {}
        if self.restore():
            return
        self.seen = self.look()
        self.keep()

    def look(self) -> dict[str, int]:
        found = {}
        with os.scandir(self.root) as items:
            for e in items:
                if suffix(e.name) in WATCHED and e.is_file():
                    found[e.path] = e.stat().st_mtime_ns
        return found

    def restore(self) -> bool:
        """Reads the log back: the state it starts from and the entries after it. A last line cut short was never an offset."""
        if not storage.names(self.log):
            return False
        for name in storage.names(self.log):
            for line in storage.read_bytes(f"{self.log}/{name}").decode().splitlines():
                record = json.loads(line)
                if "seen" in record:
                    self.end, self.seen, self.entries = record["end"], record["seen"], {int(k): tuple(v) for k, v in record["entries"].items()}
                else:
                    self.add(record["n"], record["path"], record["at"])
        return True

    def add(self, n: int, path: str, at: int | None) -> None:
        if at is None:
            self.seen.pop(path, None)
            return
        self.seen[path], self.entries[n], self.end = at, (path, at), max(self.end, n + 1)

    def keep(self) -> None:
        """One file that stands for all of the log so far; older ones go."""
        before = storage.names(self.log)
        store, path = storage.filesystem(self.log)
        name = f"{int(before[-1].split('.')[0]) + 1 if before else 0:020d}.json"
        record = {"end": self.end, "seen": self.seen, "entries": self.entries}
        storage.write_bytes(f"{self.log}/.{name}", json.dumps(record).encode())
        store.move(f"{path}/.{name}", f"{path}/{name}")
        for old in before:
            store.delete_file(f"{path}/{old}")

    def __getstate__(self) -> dict:
        return {"root": self.root, "log": self.log, "per_part": self.per_part}  # tasks need no more

    def initialOffset(self) -> dict:
        return {"at": min(self.entries, default=self.end)}

    def latestOffset(self) -> dict:
        now = self.look()
        written = sorted((at, path) for path, at in now.items() if self.seen.get(path) != at)
        gone = [path for path in self.seen if path not in now]
        if written or gone:
            lines = [{"n": self.end + k, "path": path, "at": at} for k, (at, path) in enumerate(written)] + [{"n": 0, "path": path, "at": None} for path in gone]
            name = f"{int(storage.names(self.log)[-1].split('.')[0]) + 1:020d}.json"
            store, path = storage.filesystem(self.log)
            storage.write_bytes(f"{self.log}/.{name}", "\n".join(map(json.dumps, lines)).encode())
            store.move(f"{path}/.{name}", f"{path}/{name}")  # whole or not at all
            for x in lines:
                self.add(x["n"], x["path"], x["at"])
        return {"at": self.end}

    def partitions(self, start: dict, end: dict) -> list[EventPart]:
        own = [self.entries[n] for n in range(start["at"], end["at"])]
        return [EventPart(own[i : i + self.per_part]) for i in range(0, len(own), self.per_part)]

    def read(self, partition: EventPart) -> Iterator[tuple]:
        for path, at in getattr(partition, "entries", None) or []:
            try:
                yield path, datetime.fromtimestamp(at / 1e9, UTC), read_text(path)
            except FileNotFoundError:
                continue

    def commit(self, end: dict) -> None:
        done = [n for n in self.entries if n < end["at"]]
        for n in done:
            del self.entries[n]
        if len(storage.names(self.log)) >= KEPT_LOGS:
            self.keep()


class FileEvents(DataSource):
    """``spark.readStream.format("file_events").option("log", ...).load(folder)``: one row each time that a file of the folder is written."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "path string, ts timestamp, content string"

    def streamReader(self, schema) -> EventReader:
        return EventReader(dict(self.options))


def read_events(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """The stream of writes to files of ``folder``; ``log`` is a folder of its own, kept as long as the query's checkpoint."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("log", log).load(folder)
