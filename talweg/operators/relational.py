"""Keyed look-ups, filters, selections and set operations of the river engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.ranks import row_ranks
from talweg.session import Scratch


def hits_and_misses(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Every requested id with ``found``."""
    return ids.join(known.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def last_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pos): of repeated keys the last position."""
    return rows.groupBy(key).agg(F.max(pos).alias(pos))


def gather(ids: DataFrame, values: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """The value of each id; ``default`` where the id is absent, null where it is there with a null."""
    have = values.select(key, value).withColumn("_there", F.lit(True))
    return ids.join(have, key, "left").withColumn(value, F.when(F.col("_there").isNull(), F.lit(default)).otherwise(F.col(value))).drop("_there")


def strict_gather(ids: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join that fails at run time if an id has no value."""
    have = values.withColumn("_there", F.lit(True))
    out = ids.join(have, key, "left")
    return out.filter(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no value for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)).drop("_there")


def merge_keeping_rows(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner joins of several tables on one key; raises if a row of the first gets lost or doubled."""
    out = reduce(lambda a, b: a.join(b, key), frames)
    if out.count() != frames[0].count():
        raise ValueError("the merge loses or doubles rows")
    return out


def as_of(probes: DataFrame, steps: DataFrame, probe: str, at: str, value: str) -> DataFrame:
    """Each probe with the value of the last step at or before it, of the first step if none is. Steps are a schedule of bounded size."""
    rows = steps.agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("_s"))
    upto = F.filter("_s", lambda s: s[at] <= F.col(probe))
    hit = F.when(F.size(upto) > 0, F.element_at(upto, -1)).otherwise(F.get("_s", F.lit(0)))
    return probes.crossJoin(F.broadcast(rows)).withColumn(value, hit[value]).drop("_s")


def as_of_sorted(probes: DataFrame, steps: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """As-of join of any size: both sides in one window per group, the last known value carried forward."""
    both = probes.withColumns({value: F.lit(None), "_probe": F.lit(1)}).unionByName(steps.withColumn("_probe", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(F.col("_probe") == 0, F.col(value)), ignorenulls=True).over(w)).filter("_probe = 1").drop("_probe")


def whole_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups in which no value is null."""
    return rows.groupBy(group).agg((F.count("*") == F.count(value)).alias("_ok")).filter("_ok").select(group)


def argmax_last(a: Column) -> Column:
    """0-based position of the largest element, the last of equals; -1 for an empty array."""
    return F.size(a) - F.array_position(F.reverse(a), F.array_max(a)).cast("int")


def circular_distance(a: Column, b: Column, n: int = 24) -> Column:
    d = F.abs(a - b)
    return F.least(d, n - d)


def newest(rows: DataFrame, order: list[Column], keep: int, by: list[str]) -> DataFrame:
    """The first ``keep`` rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= keep).drop("_rn")


def differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right, state): keys changed, or on one side only."""
    x, y = a.select(key, F.col(value).alias("left")).withColumn("_l", F.lit(1)), b.select(key, F.col(value).alias("right")).withColumn("_r", F.lit(1))
    state = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("left").eqNullSafe(F.col("right")), "changed")
    return x.join(y, key, "full").withColumn("state", state).filter("state is not null").select(key, "left", "right", "state")


def stratified_split(rows: DataFrame, key: str, size: str, seed: int = 42) -> DataFrame:
    """(key, tercile, split): terciles by size, in each the first 10 % of a seeded order to val, the next 20 % to test, the rest to train.

    The ranks over the whole table and those inside a tercile both come by ranges, so no task holds more than one.
    """
    scratch = Scratch(rows.sparkSession)
    own = scratch.save(rows.select(key, size), "own")
    third = -(-own.count() // 3) or 1
    t = row_ranks(own, [size, key]).select(key, F.floor(F.col("rank") / third).cast("int").alias("tercile"))
    t = scratch.save(t.withColumn("_o", F.sha2(F.concat_ws("|", F.col(key), F.lit(str(seed))), 256)), "terciles")
    sizes = t.groupBy("tercile").agg(F.count("*").alias("_m"))  # three rows
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_m").over(Window.orderBy("tercile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    i = F.col("rank") - F.col("_s") + 1
    n_val, n_test = F.round(F.col("_m") * 0.10), F.round(F.col("_m") * 0.20)
    split = F.when(i <= n_val, "val").when(i <= n_val + n_test, "test").otherwise("train")
    return row_ranks(t, ["tercile", "_o", key]).join(F.broadcast(starts), "tercile").select(key, "tercile", split.alias("split"))
