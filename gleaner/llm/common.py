"""What the operators of this subpackage share: the scratch folder and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import filesystem

#: Words as the contracts define them: runs of anything but blank and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where the setting is absent on a single machine, as in tests, a local temporary folder takes its place; a
    cluster without it is refused, as its executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the scratch folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` (or parts of them) that no later job reads: whatever came of them is saved itself."""
    for df in tables:
        store, path = filesystem(df.saved_at)
        store.delete_dir(path)


def within(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of ``rows`` whose ``key``, a 64-bit hash, is among its ``n`` smallest values.

    Keys alone are ordered, and of them only about ``n``, after a cut that follows from their number; nothing else of
    the rows is moved. Rows of equal keys stay together, so there may be more than ``n``; a null key counts as none.
    """
    distinct = rows.agg(F.approx_count_distinct(key)).first()[0]
    cut = int(min(1.0, (1.5 * n + 200) / max(1, distinct)) * 2**64) - 2**63
    few = rows.select(key).where(F.col(key) <= F.lit(min(cut, 2**63 - 1))).distinct()
    last = few.orderBy(key).limit(n).agg(F.max(key)).first()[0]
    return rows.where(F.col(key) <= F.lit(last))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding in bytes what Spark hands to Python at once: texts may be of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df
