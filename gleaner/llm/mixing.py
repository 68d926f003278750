"""Mixing sources to target weights.

Rows get a hash-random key, are range-sorted by it within their source, and distributed prefix sums of
their sizes tell where each source's budget cuts. A budget above the source's size repeats whole epochs.

A source's range is dealt over many tasks by leading key digits (``bucket``): sums per bucket give each
bucket its offset, and a window sums inside the bucket. Which buckets exist does not change the result,
as the bucket number rises with the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows of a bucket, and buckets of a source: a source of any size has at most this many offsets to sum.
BUCKET_ROWS = 1024
MAX_BUCKETS = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: ``_s`` (source), ``_rows``, ``_total`` and ``_target``.

    Sources by code point, null last, weigh ``weights`` in turn. Targets stop at ``most`` times the
    source's size; the excess goes to the others by weight. With sources in order of cap over weight,
    those before the first whose cap exceeds its share at the current level are full, and that level
    serves the rest, which is where repeated resharing ends. Sources, a row each, are ordered in one task: the column
    is one of sources, not of millions of values.
    """
    per = sized.groupBy("_s").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_total"))
    by_name = Window.orderBy(F.col("_s").isNull(), F.col("_s"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("_total") * most)
    by_ratio = Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), F.col("_s").isNull(), F.col("_s"))
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)).cast("double")
    left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    per = per.withColumn("_budget", F.sum("_total").over(whole).cast("double") * share)
    per = per.withColumn("_level", rest / left.cast("double"))
    fits = F.col("_cap").cast("double") / F.col("_w") >= F.col("_level")
    level = F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))
    return per.select("_s", "_rows", "_total", target.alias("_target"))


def mix(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", seed: int = 1, **how) -> DataFrame:
    """``df``'s rows as struct ``row`` with ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` counts words that the mix takes of the row, epochs added up; the row at the budget's cut
    is taken in part, so a source's taken words are its target rounded down.

    Null sizes count 0; a null source is a source of its own; rows with equal keys (repeated rows) are
    taken in order of size, then of a hash of the whole row, so reruns agree. A source of size 0 has target 0. An empty table gives no rows. Columns of
    ``df`` stay inside ``row``, so their names cannot clash.
    """
    rank = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"/{seed}")))
    sized = df.select(F.struct("*").alias("row"), F.col(source).alias("_s"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), rank.alias("_key"), F.xxhash64("*").alias("_tie"))
    sized = saved(sized, "mix-sized")
    targets = saved(source_targets(sized, **how).withColumnRenamed("_s", "_t"), "mix-targets")
    # The number of buckets follows the source's rows; the join broadcasts only if the saved table is below Spark's threshold.
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_rows") / BUCKET_ROWS))
    digits = F.conv(F.substring("_key", 1, 4), 16, 10).cast("long")
    dealt = sized.join(targets, F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_b", F.floor(digits * buckets / 65536))
    group = ("_g", "_b")
    dealt = dealt.withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col("_s")), F.lit("")))
    sums = dealt.groupBy(*group).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(sums.select(*group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")), "mix-offsets")
    inside = Window.partitionBy(*group).orderBy("_key", f"row.{key}", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    budget = F.floor("_target").cast("long")
    epochs = F.when(F.col("_total") > 0, F.expr("cast(floor(_target) as bigint) div _total")).otherwise(0)
    ranked = dealt.join(offsets, [*group]).withColumn("_start", start).withColumn("_epochs", epochs)
    rest = budget - F.col("_epochs") * F.col("_total") - F.col("_start")
    taken = F.col("_epochs") * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    return ranked.select("row", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"))
    return mix(docs, F.col("n")).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/1') AS k
  FROM documents),
per AS (
  SELECT s, sum(size)::BIGINT AS total,
         CASE (row_number() OVER (ORDER BY s IS NULL, encode(s)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w
  FROM sized GROUP BY s),
lv AS (
  SELECT s, total, w, 2 * total AS cap, (2 * total)::DOUBLE / w AS ratio,
         ((sum(total) OVER ())::DOUBLE * 1.5 - coalesce(sum(2 * total) OVER b, 0)::DOUBLE)
           / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lvl
  FROM per
  WINDOW b AS (ORDER BY (2 * total)::DOUBLE / w, s IS NULL, encode(s) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT s, total, least(cap::DOUBLE, coalesce((SELECT arg_min(lvl, (ratio, s IS NULL, encode(s))) FROM lv WHERE ratio >= lvl), 0.0) * w) AS target
  FROM lv),
ranked AS (
  SELECT z.doc_id, z.size, t.total, t.target,
         coalesce(sum(z.size) OVER (PARTITION BY z.s ORDER BY z.k, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN t.total > 0 THEN floor(t.target)::BIGINT // t.total ELSE 0 END AS epochs
  FROM sized z JOIN targets t ON z.s IS NOT DISTINCT FROM t.s)
SELECT doc_id, size, total AS source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * total - start)))::BIGINT AS taken
FROM ranked
"""
