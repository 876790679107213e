"""Windows, resampling and shapes of daily and hourly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.common import sized_join
from talweg.session import Scratch


def day_axis(first: Column, last: Column) -> Column:
    """The inclusive daily axis as an array."""
    return F.sequence(first, last, F.expr("interval 1 day"))


def with_neighbours(daily: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """Adds ``before`` and ``after``: the values one day earlier and later; the own value at a gap or an end."""
    w = Window.partitionBy(by).orderBy(day)
    near = lambda f, n: F.when(f(F.col(day), 1).over(w) == F.date_add(F.col(day), n), f(F.col(value), 1).over(w))
    return daily.withColumns({"before": F.coalesce(near(F.lag, -1), F.col(value)), "after": F.coalesce(near(F.lead, 1), F.col(value))})


def to_hourly(daily: DataFrame, by: str, day: str, value: str, mode: str = "nearest") -> DataFrame:
    """(by, day, hour, value): repeated, or interpolated through the middles of the days, linear or quadratic, never below 0."""
    h = F.explode(F.sequence(F.lit(0), F.lit(23)))
    if mode == "nearest":
        return daily.select(by, day, h.alias("hour"), F.col(value))
    x = (F.col("hour") + 0.5) / 24.0 - 0.5
    v, a, b = F.col(value), F.col("before"), F.col("after")
    if mode == "linear":
        y = F.when(x < 0, (1 + x) * v - x * a).otherwise((1 - x) * v + x * b)
    elif mode == "quadratic":
        y = v + 0.5 * (b - a) * x + 0.5 * (a - 2 * v + b) * x * x
    else:
        raise ValueError(mode)
    out = with_neighbours(daily, by, day, value).select(by, day, h.alias("hour"), value, "before", "after")
    return out.select(by, day, "hour", F.greatest(y, F.lit(0.0)).alias(value))


def pool_days(hourly: DataFrame, by: str, ts: str, value: str, tau: int) -> DataFrame:
    """(by, day, value): means over 24 hours that begin ``tau`` hours into the day; only whole days."""
    if not 0 <= tau < 24:
        raise ValueError("tau must be in [0, 24)")
    day = (F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(tau), F.lit(0), F.lit(0))).cast("date")
    return hourly.groupBy(by, day.alias("day")).agg(F.avg(value).alias(value), F.count(value).alias("hours"))


def area_pool(cells: DataFrame, by: str, pos: str, value: str, n_bins: int) -> DataFrame:
    """(by, bin, value): L cells resampled to ``n_bins`` bins by overlap; positions count from 0 without gaps."""
    n = Window.partitionBy(by)
    s = cells.withColumn("_l", F.count("*").over(n)).withColumn("_s", F.col("_l") / F.lit(float(n_bins)))
    first = F.floor(F.col(pos) / F.col("_s"))
    last = F.least(F.floor((F.col(pos) + 1) / F.col("_s") - 1e-12), F.lit(n_bins - 1))
    s = s.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    left, right = F.greatest(F.col(pos).cast("double"), F.col("bin") * F.col("_s")), F.least(F.col(pos) + 1.0, (F.col("bin") + 1) * F.col("_s"))
    return s.groupBy(by, "bin").agg(F.sum(F.col(value) * (right - left) / F.col("_s")).alias(value))


def standardise(rows: DataFrame, by: str, value: str, out: str = "z", log: bool = False) -> DataFrame:
    """Adds the z-score within the group, of log1p if asked; 0 where the deviation is under 1e-6."""
    x = F.log1p(value) if log else F.col(value)
    norms = Scratch(rows.sparkSession).save(rows.groupBy(by).agg(F.stddev_pop(x).alias("_sd"), F.avg(x).alias("_mean")), "norms")
    got = sized_join(rows, norms, [by], "left")
    return got.withColumn(out, F.when(F.col("_sd") < 1e-6, 0.0).otherwise((x - F.col("_mean")) / F.when(F.col("_sd") >= 1e-6, F.col("_sd")))).drop("_sd", "_mean")


def day_runs(days: DataFrame, by: str, day: str, length: int) -> DataFrame:
    """(by, day, run, chunk): days of unbroken runs cut into chunks of ``length``; incomplete chunks are dropped. Repeated days count once."""
    d = days.select(by, day).distinct()
    w = Window.partitionBy(by).orderBy(day)
    d = d.withColumn("run", F.date_sub(F.col(day), F.row_number().over(w)))
    i = F.row_number().over(Window.partitionBy(by, "run").orderBy(day)) - 1
    d = d.withColumn("chunk", F.floor(i / length))
    return d.withColumn("_n", F.count("*").over(Window.partitionBy(by, "run", "chunk"))).filter(F.col("_n") == length).drop("_n")


def softmax(rows: DataFrame, by: list[str], logit: str, out: str = "share") -> DataFrame:
    """Adds exp(x - max) over its sum within the group."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return rows.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def boundary_blend(shapes: DataFrame, by: str, day: str, shape: str, strength: float) -> DataFrame:
    """Daily shapes of 24 shares with the last hour of a day and the first of the next drawn together; each day still sums to 1."""
    w = Window.partitionBy(by).orderBy(day)
    s = F.col(shape)
    p0, p23 = s[0], s[23]
    nxt = F.when(F.lead(day).over(w) == F.date_add(F.col(day), 1), F.lead(p0).over(w))
    prv = F.when(F.lag(day).over(w) == F.date_sub(F.col(day), 1), F.lag(p23).over(w))
    q23 = F.coalesce(p23 + ((p23 + nxt) / 2 - p23) * strength, p23)
    q0 = F.coalesce(p0 + ((p0 + prv) / 2 - p0) * strength, p0)
    out = shapes.withColumns({"_q0": q0, "_q23": q23})
    scale = (1 - F.col("_q0") - F.col("_q23")) / (1 - F.col(shape)[0] - F.col(shape)[23] + 1e-6)
    middle = F.transform(F.slice(shape, 2, 22), lambda x: x * F.col("_scale"))
    return out.withColumn("_scale", scale).withColumn(shape, F.concat(F.array("_q0"), middle, F.array("_q23"))).drop("_q0", "_q23", "_scale")
