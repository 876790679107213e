"""Running totals over groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.common import sized_join
from talweg.session import Scratch


def running_total(df: DataFrame, group: list[str], order_key: Column, tie: list[str], weight: str, out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows before this one in its group, in the order of a 64-bit hash key.

    ``order_key`` is a long that spreads evenly (a hash); ``tie`` makes the order total. Each group is cut into ranges of the
    key, so many that one of them would have about ``rows_per_bucket`` rows if the group had all; the ranges' sums are added
    up, and the window inside a range starts from there. So a group with a third of all rows is summed by many tasks. Null
    weights count as 0.
    """
    bits = max(0, math.ceil(math.log2(max(1, df.count() / rows_per_bucket))))
    at = df.withColumn("_k", order_key).withColumn("_b", (F.shiftrightunsigned("_k", 64 - bits) if bits else F.lit(0)).cast("int"))
    at = at.withColumn("_w", F.coalesce(F.col(weight), F.lit(0)))
    scratch = Scratch(df.sparkSession)
    sums = at.groupBy(*group, "_b").agg(F.sum("_w").alias("_s"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(sums.withColumn("_start", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s"), "starts")
    inner = Window.partitionBy(*group, "_b").orderBy("_k", *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = sized_join(at, starts, [*group, "_b"])
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_w").over(inner), F.lit(0))).drop("_k", "_b", "_w", "_start")
