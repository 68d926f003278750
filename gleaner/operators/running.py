"""Running sums and numbers over all rows of a table in one order, in partial blocks.

A window without a partition puts the whole table into one task. Here rows are range-partitioned in their order and
written; every block is summed by itself, and what the blocks before it hold, a row a task, is told to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved


def sums_before(rows: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows that come before each in ``order``; nulls count as zero.

    ``value`` must add up exactly (integers or decimals), or the result would depend on where blocks are cut. Rows that are
    equal in ``order`` lie in one block, in any order; name enough columns for reruns to agree. A table without rows has none.
    """
    cut = rows.withColumn(name, F.coalesce(value, F.lit(0))).repartitionByRange(*order).withColumn("_block", F.spark_partition_id())
    table = saved(cut, name)
    total = table.schema[name].dataType
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over a row a task
    ahead = table.groupBy("_block").agg(F.sum(name).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = table.withColumn(name, F.coalesce(F.sum(name).over(own), F.lit(0).cast(total))).join(F.broadcast(ahead), "_block")
    return out.withColumn(name, F.col(name) + F.col("_ahead")).drop("_block", "_ahead")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in ``order``."""
    return sums_before(rows, F.lit(1).cast("long"), order, name).withColumn(name, (F.col(name) + 1).cast("int"))
