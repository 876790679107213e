"""Both ways of the join by size give the same."""

import pytest
from pyspark.sql import functions as F
from talweg.functions.common import sized_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_the_salted_way_gives_the_same(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 5).alias("x"))
    big = big.unionByName(spark.createDataFrame([(None, 1), (7, 1), (7, 1), (99, 2)], "k long, x long"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    rows = lambda df: sorted(map(tuple, df.select("k", "x", "v").collect()), key=str)
    want = rows(big.join(small, "k", how))
    assert rows(sized_join(big, small, ["k"], how)) == want
    for hot in (1, 100, 10_000):
        salted = sized_join(big, small, ["k"], how, limit_rows=0, hot_rows=hot)
        assert "_salt" in salted._jdf.queryExecution().toString() and rows(salted) == want
        assert salted.columns == big.join(small, "k", how).columns


def test_the_salted_way_with_empty_sides(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert sized_join(spark.range(3).withColumnRenamed("id", "k"), none, ["k"], "left", rows=1_000_000).count() == 3
    assert sized_join(none.select("k"), none, ["k"], rows=1_000_000).count() == 0
