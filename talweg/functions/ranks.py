"""Ranks and order statistics of groups of any size, by ranges of the values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.common import sized_join
from talweg.session import Scratch


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows cut into ranges of ``order`` as ``_pid``; written, as the cuts are sampled and must not change afterwards."""
    return Scratch(df.sparkSession).save(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")


def row_ranks(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row in the order of ``order`` over the whole table; no task holds more than a range."""
    parts = _ranged(df, order)
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_pid").agg(F.count("*").alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))  # one row per range
    inner = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return parts.withColumn("_i", inner).join(F.broadcast(starts), "_pid").withColumn(out, F.col("_start") + F.col("_i")).drop("_pid", "_i", "_start")


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, count, before): of each distinct non-null value of a group how often it occurs and how many values are smaller."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("count"))
    parts = _ranged(counts, [*by, value])
    # only a group that crosses from one range into the next has values before a range: as many rows as ranges
    sums = parts.groupBy(*by, "_pid").agg(F.sum("count").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.sum("_n").over(w)).filter("_start > 0").select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_start")
    on = parts["_pid"] == starts["_p"]
    for i, c in enumerate(by):
        on = on & parts[c].eqNullSafe(starts[f"_k{i}"])
    inner = Window.partitionBy("_pid", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    got = parts.withColumn("_in", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(F.broadcast(starts), on, "left")
    return got.select(*by, value, "count", (F.col("_in") + F.coalesce("_start", F.lit(0))).alias("before"))


def order_statistics(df: DataFrame, by: list[str], value: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, names): of each group the values at 0-based positions of its sorted non-null values, linear between two neighbours.

    ``at`` gives a position from the number of values. A group without values, or with a null key, does not come out; with no
    ``by`` the whole table is one group.
    """
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    ranks = Scratch(df.sparkSession).save(value_ranks(rows.select(*keys, value), keys, value), "ranks")
    n = ranks.groupBy(*keys).agg(F.sum("count").alias("n"))
    joined = sized_join(ranks, n, keys)
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("count"))
    found, out = [], []
    for name, position in at.items():
        p = position(F.col("n")).cast("double")
        found += [F.max(F.when(holds(F.floor(p)), F.col(value))).alias(f"_lo_{name}"), F.max(F.when(holds(F.ceil(p)), F.col(value))).alias(f"_hi_{name}")]
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - F.floor(p))).alias(name))
    return joined.groupBy(*keys, "n").agg(*found).select(*by, "n", *out)


def interpolated(p: float) -> Callable[[Column], Column]:
    """Linear interpolation between closest ranks."""
    return lambda n: (n - 1) * F.lit(float(p))


def nearest(p: float) -> Callable[[Column], Column]:
    """The element at round((n - 1) p), halves away from zero."""
    return lambda n: F.round((n - 1) * F.lit(float(p)))


def upper_middle(n: Column) -> Column:
    """The element at n div 2."""
    return F.floor(n / 2)
