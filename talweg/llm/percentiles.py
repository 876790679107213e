"""Percentiles per group over very large columns: distributed multi-select, and summaries that combine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.common import finite, sized_join
from talweg.session import Scratch

#: A range of at most so many values is sorted in one place.
FINISH_ROWS = 4096
#: Values that one local proposal covers.
BLOCK_ROWS = 1 << 19

_STATS = "iid long, n_lt long, n_eq long, n_gt long, med_lt double, med_gt double"


def _three_way(iid: np.ndarray, pivot: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Per range of one block: values below, at and above the pivot, and the median of either side."""
    o = np.lexsort((value, iid))
    iid, pivot, value = iid[o], pivot[o], value[o]
    start = np.flatnonzero(np.r_[True, iid[1:] != iid[:-1]])
    total = np.diff(np.r_[start, len(iid)])
    lt = np.add.reduceat((value < pivot).astype("i8"), start)
    eq = np.add.reduceat((value == pivot).astype("i8"), start)
    gt = total - lt - eq
    below = value[np.minimum(start + np.maximum(lt - 1, 0) // 2, len(value) - 1)]
    above = value[np.minimum(start + lt + eq + np.maximum(gt - 1, 0) // 2, len(value) - 1)]
    cols = [pa.array(iid[start]), pa.array(lt), pa.array(eq), pa.array(gt), pa.array(below, mask=lt == 0), pa.array(above, mask=gt == 0)]
    return pa.RecordBatch.from_arrays(cols, ["iid", "n_lt", "n_eq", "n_gt", "med_lt", "med_gt"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return _three_way(*[t[c].to_numpy() for c in ("iid", "pivot", "value")])

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def group_percentiles(values: DataFrame, keys: list[str], value: str, probs: list[float], finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(keys, n, quantiles): exact percentiles of the finite values of each group, by linear interpolation; ``quantiles`` follows ``probs``.

    Multi-select. Every group starts as one range with the order statistics it has to find. A round reads the values that
    lie in a range of more than ``finish_rows`` values, block by block; each block counts three ways around the range's
    pivot and proposes the medians of its two sides. The counts add up to the new sub-ranges, the weighted median of the
    proposals is the next pivot, and what holds no wanted order statistic is ruled out. At least a quarter of a range goes
    each round, so rounds grow with log(rows / finish_rows). When less than a quarter of the stored values is still in
    play they are written anew. Small ranges are sorted at last. No group is ever gathered whole, so it may hold any share
    of the rows.

    Null, NaN and infinite values are left out; a group without any other value does not come out; a null key is a group;
    equal values and repeated rows count as often as they are there; an empty table gives an empty one.
    """
    spark, scratch = values.sparkSession, Scratch(values.sparkSession)
    names = [f"_g{i}" for i in range(len(keys))]
    raw = values.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], finite(value).alias("value")).filter(F.col("value").isNotNull())
    raw = scratch.save(raw, "raw")
    groups = scratch.save(raw.groupBy(*names).agg(F.count("*").alias("n")).withColumn("gid", F.monotonically_increasing_id()), "groups")
    safe = [F.struct(F.col(n)).cast("string").alias(f"{n}s") for n in names]
    lookup = groups.select(*safe, "gid")
    data = sized_join(raw.select(*safe, "value"), lookup, [f"{n}s" for n in names]).select("gid", "value")
    data = scratch.save(data, "data0")
    scratch.drop("raw")
    ranks = F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in probs]))
    inf = F.lit(math.inf)
    state = groups.select("gid", F.col("gid").alias("iid"), (-inf).alias("lo"), inf.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), F.array_distinct(ranks).alias("ranks"), (-inf).alias("pivot"))
    state = scratch.save(state, "state0")
    schema = state.schema
    small, found = ["state0"], []
    stored = data_name = None
    rounds = 0
    while True:
        total, ranges = state.filter(F.col("size") > finish_rows).agg(F.sum("size"), F.count("*")).first()
        if not ranges:
            break
        rounds += 1
        active = scratch.save(state.filter(F.col("size") > finish_rows), f"active{rounds}")
        asked = _in_ranges(data, active.select("gid", "iid", "lo", "hi", "pivot"), ranges)
        own = asked.filter((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")))
        if stored is not None and total < stored / 4 or stored is None and rounds > 1:
            data_name, old = f"data{rounds}", data_name
            data = scratch.save(own.select("gid", "value"), data_name)
            stored = total
            if old:
                scratch.drop(old)
            own = _in_ranges(data, active.select("gid", "iid", "lo", "hi", "pivot"), ranges).filter((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")))
        parts = own.select("iid", "pivot", "value").mapInArrow(_propose, _STATS)
        sums = parts.groupBy("iid").agg(
            *[F.sum(c).alias(c) for c in ("n_lt", "n_eq", "n_gt")],
            F.expr("percentile(med_lt, 0.5D, n_lt)").alias("p_lt"),
            F.expr("percentile(med_gt, 0.5D, n_gt)").alias("p_gt"),
        )
        cut = scratch.save(active.join(sums, "iid"), f"cut{rounds}")
        from_lt, upto_eq = F.col("below") + F.col("n_lt"), F.col("below") + F.col("n_lt") + F.col("n_eq")
        hit = cut.select("gid", F.explode(F.filter("ranks", lambda r: (r >= from_lt) & (r < upto_eq))).alias("rank"), F.col("pivot").alias("value"))
        low = F.struct("lo", F.col("pivot").alias("hi"), "below", F.col("n_lt").alias("size"), F.filter("ranks", lambda r: r < from_lt).alias("ranks"), F.col("p_lt").alias("pivot"))
        high = F.struct(F.col("pivot").alias("lo"), "hi", upto_eq.alias("below"), F.col("n_gt").alias("size"), F.filter("ranks", lambda r: r >= upto_eq).alias("ranks"), F.col("p_gt").alias("pivot"))
        both = cut.select("gid", F.explode(F.array(low, high)).alias("s")).select("gid", F.xxhash64("gid", "s.lo", "s.hi").alias("iid"), "s.*").filter(F.size("ranks") > 0)
        scratch.save(hit, f"hit{rounds}")
        state = scratch.save(both.select(*schema.names), f"state{rounds}")
        found.append(f"hit{rounds}")
        small.append(f"state{rounds}")
        scratch.drop(f"active{rounds}", f"cut{rounds}")
    rest = scratch.read(*small, schema=schema).filter(F.col("size") <= finish_rows)
    rest = scratch.save(rest, "rest")
    all_data = scratch.read("data0", schema="gid long, value double")
    inside = _in_ranges(all_data, rest.select("gid", "lo", "hi", "below", "ranks")).filter((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")))
    sorted_ = inside.groupBy("gid", "below").agg(F.array_sort(F.collect_list("value")).alias("v"), F.first("ranks").alias("ranks"))
    last = sorted_.select("gid", "below", "v", F.explode("ranks").alias("rank")).select("gid", "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    if found:
        last = last.unionByName(scratch.read(*found, schema="gid long, rank long, value double"))
    table = last.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    pick = lambda r: F.try_element_at("at", r)
    each = [pick(F.floor(place(p))) + (place(p) - F.floor(place(p))) * (pick(F.ceil(place(p))) - pick(F.floor(place(p)))) for p in probs]
    return groups.join(table, "gid").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", F.array(*each).alias("quantiles"))


def _in_ranges(data: DataFrame, ranges: DataFrame, rows: int | None = None) -> DataFrame:
    """Values with the ranges of their group: a group has at most two ranges for each percentile asked."""
    return sized_join(data, ranges, ["gid"], rows=rows)


def bin_counts(values: DataFrame, keys: list[str], value: str, error: float = 0.01) -> DataFrame:
    """A summary that combines: (keys, bin, n), logarithmic bins in which every value is within ``error`` of its bin's middle.

    Summaries of loads, zones or days combine by adding ``n``; put the period among the keys and leave it out later.
    Zeros have bin null; a negative value has the bin of its absolute value under ``sign`` -1. Null, NaN and infinite
    values are left out. The number of bins depends on the range of the values only, not on their number.
    """
    gamma = (1 + error) / (1 - error)
    v = finite(value)
    b = F.when(v != 0, F.ceil(F.log(F.abs(v)) / math.log(gamma)).cast("int"))
    return values.withColumns({"_v": v, "_b": b}).filter(F.col("_v").isNotNull()).groupBy(*keys, F.signum("_v").cast("int").alias("sign"), F.col("_b").alias("bin")).agg(F.count("*").alias("n"))


def percentiles_of_bins(counts: DataFrame, keys: list[str], probs: list[float], error: float = 0.01) -> DataFrame:
    """(keys, n, quantiles) of combined summaries: linear between the values of the two ranks next to (n - 1) p, each of them within a relative ``error``."""
    from pyspark.sql import Window

    gamma = (1 + error) / (1 - error)
    middle = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bin")) / (gamma + 1))
    summed = counts.groupBy(*keys, "sign", "bin").agg(F.sum("n").alias("n")).withColumn("mid", middle)
    w = Window.partitionBy(*keys)
    ranked = summed.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("mid").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("mid")))
    place = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    picks = [at(f(x)).alias(f"_{n}{i}") for i, x in enumerate(place) for n, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy(*keys, "total").agg(*picks)
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (x - F.floor(x)) for i, x in enumerate(place)]
    return found.select(*keys, F.col("total").alias("n"), F.array(*between).alias("quantiles"))
