"""Nested intervals: which nodes of a tree lie around which, as an equality join.

A node of a file is an interval of offsets, and its ancestors are the intervals around it. Every interval is cut into
buckets of powers of two (at most two a level), and a point lies in one bucket a level; so "lies within" becomes
equality of file, level and bucket. No pair is met that is not in the result, and no interval is compared with all points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("path", "_level", "_bucket")


def reached(offset: str) -> str:
    """The highest level that has a whole bucket up to ``offset``."""
    return f"length(bin(greatest({offset} + 1L, 0L))) - 1"


def buckets(pre: str, post: str) -> Column:
    """The buckets that make up the offsets from ``pre`` to ``post``; no level is looked at that the offsets do not reach."""
    first, end = f"shiftright({pre} + shiftleft(1L, l) - 1L, l)", f"shiftright({post} + 1L, l)"
    part = lambda odd, bucket: f"transform(filter(sequence(0, {reached(post)}), l -> {first} < {end} and {odd} % 2 = 1), l -> struct(l as level, {bucket} as bucket))"
    return F.expr(f"concat({part(first, first)}, {part(end, f'{end} - 1L')})")


def around(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of ``inner`` (path, pre, end, ...) with each row of ``outer`` (path, pre, post, ...) whose interval holds ``pre``.

    ``end`` is an offset that no interval of the file passes. Columns of ``outer`` come as ``o_<name>``. Intervals need not nest;
    rows without a partner are left out; an interval whose post lies before its pre holds nothing.
    """
    cut = outer.select("path", F.explode(buckets("pre", "post")).alias("_b"), *(F.col(c).alias(f"o_{c}") for c in outer.columns if c != "path"))
    left = cut.select("path", F.col("_b.level").alias("_level"), F.col("_b.bucket").alias("_bucket"), *(c for c in cut.columns if c.startswith("o_")))
    points = inner.withColumn("_level", F.explode(F.expr(f"sequence(0, {reached('end')})"))).withColumn("_bucket", F.expr("shiftright(pre, _level)"))
    return points.join(left, [*KEY]).drop("_level", "_bucket")


def ancestors(nodes: DataFrame, of: Column, kinds: tuple[str, ...]) -> DataFrame:
    """Pairs of a node of ``nodes`` (path, pre, post, end, depth, kind, ...) for which ``of`` holds and a node of ``kinds`` around it."""
    return around(nodes.where(F.col("kind").isin(*kinds)), nodes.where(of)).where((F.col("o_pre") < F.col("pre")) | (F.col("o_post") > F.col("post")))


def innermost(column: str) -> Column:
    """Of the pairs of a group, each of one node, the ``column`` of the node around it that begins last."""
    return F.max_by(column, F.struct("o_pre", -F.col("o_post")))


def nearest(nodes: DataFrame, of: Column, kinds: tuple[str, ...]) -> DataFrame:
    """Of those pairs the ones with the innermost node around: the one that begins last."""
    inner = Window.partitionBy("path", "pre", "post").orderBy(F.desc("o_pre"), "o_post")
    return ancestors(nodes, of, kinds).withColumn("_rank", F.row_number().over(inner)).where("_rank = 1").drop("_rank")
