"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """``v`` and its component's smallest vertex ``root``, for every vertex of ``edges`` (``u``, ``v`` long).

    Each round hangs every vertex's neighbours on the smallest of them; rounds end when a star of each
    component is left. Rounds grow with the logarithm of a component's size; minima are summed up before
    the shuffle, so a vertex with very many neighbours is no burden to one task.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours of u go to the smallest vertex of u's neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        discard(edges)
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = saved(small, "small-star")
        discard(large)
        # Done when each vertex hangs on one root and no root hangs on another.
        forked = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = small.select(F.col("v").alias("u")).join(small.select("u"), "u", "left_semi")
        if not forked.union(chained).take(1):
            roots = small.select(F.col("v").alias("root")).distinct()
            return small.select(F.col("u").alias("v"), F.col("v").alias("root")).union(roots.select(F.col("root").alias("v"), "root"))
        edges = small
