"""Null policy, station ids, divisions and percentile conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null; never an error or an infinity."""
    return F.when(b != 0, a / b)


def pad_station(c: Column | str) -> Column:
    """Zero-pad to 8 characters; longer ids stay whole."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) < 8, F.lpad(c, 8, "0")).otherwise(c)


def station_id(c: Column | str) -> Column:
    """One spelling of a station id: blanks and a provider name in front (``USGS-``, ``usgs:``, ``USGS__``) go, then zero padding.

    An empty id becomes null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^[A-Za-z]+(?:-|:|_+)\s*", "")
    return F.when(F.length(bare) > 0, pad_station(bare))


def whole_number(c: Column | str) -> Column:
    """A whole number from text in plain, decimal, scientific or thousands-grouped notation, else null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    t = F.when(t.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.0*)?$"), F.regexp_replace(t, ",", "")).otherwise(t)
    whole = F.expr("try_cast(NULL AS BIGINT)")
    plain = F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.try_cast("bigint"))
    dec = F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,2})?$"), t.try_cast("decimal(38,10)"))
    as_long = F.when(dec == F.floor(dec), dec.try_cast("bigint"))
    return F.coalesce(plain, as_long, whole)


def rank_pick(values: Column, position: Column) -> Column:
    """The element at a 0-based position of the sorted non-null values; null if there is none."""
    return F.get(F.array_sort(values), position.cast("int"))


def upper_median(values: Column) -> Column:
    """sorted[n div 2]."""
    return rank_pick(values, F.floor(F.size(values) / 2))


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[round((n - 1) p)], halves away from zero."""
    return rank_pick(values, F.round((F.size(values) - 1) * F.lit(float(p))))


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit_rows: int = 200_000, hot_rows: int = 500_000, rows: int | None = None) -> DataFrame:
    """Join where ``small`` has one row per key and ``big`` may hold a third of its rows under one key.

    ``small`` should be a written table: its rows are counted, unless ``rows`` says how many there are, and up to
    ``limit_rows`` it is broadcast. Beyond that both sides are shuffled, and keys with more than ``hot_rows`` rows in ``big``
    are salted: their rows by a hash of the row and its partition, so that a task run again salts them the same whatever the
    order of its rows, and their one row of ``small`` once per salt. No other row of ``small`` is repeated; of hot keys there
    are at most as many as ``big`` has rows by ``hot_rows``.
    Only inner and left joins (a salted anti or semi join is the same with a flag column).
    """
    if (small.limit(limit_rows + 1).count() if rows is None else rows) <= limit_rows:
        return big.join(F.broadcast(small), keys, how)
    hot = F.broadcast(big.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    salted = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    plain = [F.col(f"`{c}`") for c, t in big.dtypes if "map<" not in t]
    spread = big.withColumn("_hash", F.xxhash64(F.spark_partition_id(), *plain)).join(hot, keys, "left").withColumn("_salt", F.pmod("_hash", parts).cast("int")).drop("_hash", "_parts")
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")
