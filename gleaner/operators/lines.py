"""Files to lines, with the neighbours that rules look at, and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_lines(files: DataFrame) -> DataFrame:
    """``path`` and ``text``, the file's lines: neither trailing carriage returns nor an empty last line."""
    returned = F.when(F.contains("content", F.lit("\r")), F.regexp_replace("content", r"\r(?=\n|\z)", "")).otherwise(F.col("content"))
    raw = F.split(returned, "\n", -1)
    whole = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    return files.where("content is not null").select("path", whole.alias("text"))


def exploded(texts: DataFrame) -> DataFrame:
    """``path``, ``line`` (from 1), ``code`` and the lines before and after.

    The shifted copies are zipped before the explode, so neighbours cost no window and a row never
    carries its whole file.
    """
    none = F.array(F.lit(None).cast("string"))
    n = F.size("text")
    before = F.concat(none, F.slice("text", 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("text", 2, F.greatest(n - 1, F.lit(0))), none)
    zipped = F.arrays_zip(F.col("text").alias("code"), before.alias("before"), after.alias("after"))
    rows = texts.where(n > 0).select("path", F.posexplode(zipped).alias("i", "x"))
    return rows.select("path", (F.col("i") + 1).alias("line"), "x.code", "x.before", "x.after")
