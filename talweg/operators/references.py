"""References to records that do not exist: composite keys with partial nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.common import sized_join
from talweg.session import Scratch

MATCHES = ("simple", "partial", "full")


def null_masks(refs: DataFrame, keys: list[str]) -> list[int]:
    """The null masks that occur: bit i is set where keys[i] is null. At most 2 ** len(keys) values reach the driver."""
    mask = reduce(lambda a, b: a + b, [F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)])
    return sorted(r[0] for r in refs.select(mask.alias("m")).distinct().collect())


def reference_states(refs: DataFrame, parents: DataFrame, keys: dict[str, str], match: str = "simple", ref_time: str | None = None,
                     parent_time: str | None = None, deleted: str | None = None) -> DataFrame:
    """The rows of ``refs`` whose reference is broken, with ``ref_state``.

    ``keys`` maps columns of ``refs`` to columns of ``parents``. The references are grouped by their null mask; each mask
    is matched on its non-null columns only, under the declared semantics of SQL:

    * simple - a reference with any null column is none;
    * partial - the non-null columns must be found together in some parent; an all-null reference is none;
    * full - an all-null reference is none, a partly null one is broken (``mixed``).

    States: ``missing`` (no parent), ``deleted`` (all matching parents have ``deleted`` true), ``late`` (the earliest
    ``parent_time`` of the matching parents is after ``ref_time``); a null time is never late. Rows with sound references
    do not come out, repeated rows come out as often as they are there, an empty ``refs`` gives no row, an empty
    ``parents`` makes every reference missing. All columns of ``refs`` are kept,
    whatever they are called; only a column ``ref_state`` is replaced.

    The keys of the references are made distinct before they meet the parents, so a key that a third of all rows refer to
    takes part once; only the keys found broken are joined back, by broadcast or with the rows salted.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    ref_cols = list(keys)
    parts: list[DataFrame] = []
    out_cols = [c for c in refs.columns if c != "ref_state"]
    refs = refs.select(*out_cols)
    for mask in null_masks(refs, ref_cols):
        used = [k for i, k in enumerate(ref_cols) if not mask >> i & 1]
        if not used or mask and match == "simple":
            continue
        own = refs.filter(reduce(lambda a, b: a & b, [F.col(k).isNull() if mask >> i & 1 else F.col(k).isNotNull() for i, k in enumerate(ref_cols)]))
        if mask and match == "full":
            parts.append(own.withColumn("ref_state", F.lit("mixed")))
            continue
        names = [f"__ref_k{i}" for i in range(len(used))]
        time = F.col(ref_time) if ref_time else F.lit(None).cast("timestamp")
        asked = own.select(*[F.col(k).alias(n) for k, n in zip(used, names)], time.alias("__ref_rt")).groupBy(*names).agg(F.min("__ref_rt").alias("__ref_first_ref"))
        gone = F.col(deleted) if deleted else F.lit(False)
        ptime = F.col(parent_time) if parent_time else F.lit(None).cast("timestamp")
        held = (
            parents.select(*[F.col(keys[k]).alias(n) for k, n in zip(used, names)], gone.alias("__ref_gone"), ptime.alias("__ref_pt"))
            .filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
            .groupBy(*names)
            .agg(F.min(F.coalesce(F.col("__ref_gone"), F.lit(False))).alias("__ref_gone"), F.min("__ref_pt").alias("__ref_seen"), F.lit(True).alias("__ref_held"))
        )
        broken = asked.join(held, names, "left").filter(F.col("__ref_held").isNull() | F.col("__ref_gone") | (F.col("__ref_seen") > F.col("__ref_first_ref"))).drop("__ref_first_ref")
        broken = Scratch(refs.sparkSession).save(broken, "broken")
        state = F.when(F.col("__ref_held").isNull(), "missing").when(F.col("__ref_gone"), "deleted").when(F.col("__ref_seen") > time, "late")
        keyed = own.withColumns({n: F.col(k) for k, n in zip(used, names)})
        parts.append(sized_join(keyed, broken, names).withColumn("ref_state", state).filter(F.col("ref_state").isNotNull()).select(*out_cols, "ref_state"))
    if not parts:
        return refs.limit(0).withColumn("ref_state", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, parts)


def count_by_period(states: DataFrame, table: str, time: str, unit: str = "month") -> DataFrame:
    """(src_table, period, ref_state, n): broken references per table and period of the referring row."""
    period = F.date_trunc(unit, F.col(time)).cast("date")
    return states.groupBy(F.col(table).alias("src_table"), period.alias("period"), "ref_state").agg(F.count("*").alias("n"))
