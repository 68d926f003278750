import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import running

ROWS = "k int, v int, also string"


@pytest.mark.parametrize("rows", [0, 1, 700])
def test_sums_equal_a_walk_over_the_whole_table(spark, rows):
    r = random.Random(rows)
    data = [(r.choice([None, *range(300)]), r.choice([None, *range(-9, 99)]), f"x{i:04}") for i in range(rows)]
    df = spark.createDataFrame(data, ROWS).repartition(5)
    got = running.sums_before(df, F.col("v").cast("long"), [F.col("k").desc(), F.col("also")], "sum").collect()
    want, total = {}, 0
    for k, v, also in sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[2])):
        want[also] = (k, v, total)
        total += v or 0
    assert {x.also: (x.k, x.v, x.sum) for x in got} == want
    assert len(got) == rows


def test_blocks_are_several_tasks_and_decimals_exact(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select("id", F.lit("0.1").cast("decimal(38,12)").alias("cost"))
        out = running.sums_before(df, F.col("cost"), [F.col("id")], "spent")
        assert out.where(F.col("spent") != F.col("id") / 10).count() == 0
        assert {x.id: x.place for x in running.numbered(df, [F.desc("id")]).collect()} == {i: 1000 - i for i in range(1000)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_one_key_on_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    got = running.numbered(df, [F.col("k"), F.col("id")]).orderBy("place").collect()
    assert [(x.k, x.id) for x in got] == sorted(((7 if i % 3 == 0 else i), i) for i in range(3000))
    assert [x.place for x in got] == list(range(1, 3001))
