"""Folders that driver and executors share: scratch tables, files, and files that only one writer can create."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; without it only a single machine gets one, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in a scratch folder and read again: what made it runs once, whatever is lost later."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def names(uri: str) -> list[str]:
    """Base names of the files in a folder, in order; none where it does not exist."""
    store, path = filesystem(uri)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.is_file)


def read_bytes(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        f.write(data)


def put_if_absent(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Creates a file whole, or leaves the one that is there and returns False: of two writers one succeeds.

    A file of another name is moved to its place, which fails if the place is taken: by a hard link on a local file
    system, else by Hadoop's rename without overwriting, which is one step where the store's rename is (on HDFS it is).
    """
    aside = f"{uri}.{uuid.uuid4().hex}"
    write_bytes(aside, data)
    if urlparse(uri).scheme in ("", "file"):
        here, there = urlparse(aside).path, urlparse(uri).path
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        finally:
            os.remove(here)
        return True
    hadoop = spark._jvm.org.apache.hadoop
    source, target = hadoop.fs.Path(aside), hadoop.fs.Path(uri)
    context = hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, spark._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        if not context.util().exists(target):
            raise
        context.delete(source, False)
        return False
    return True
