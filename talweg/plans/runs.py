"""Whole runs: evaluation of a routed network against observations, and training over epochs of batches."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.operators import model as mo
from talweg.operators import scores as sc
from talweg.operators.parts import Parts


def _hours_of_days(reaches: pa.Table, first: int, end: int) -> np.ndarray:
    """Hourly inflow of the lists of days and flows of each reach."""
    lists, low = reaches["days"].combine_chunks(), first // 24
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    day, reach = lists.flatten().to_numpy() - low, np.repeat(np.arange(len(n)), n)
    m = np.zeros(((end - 1) // 24 - low + 1, len(n)))
    ok = (day >= 0) & (day < len(m))
    np.add.at(m, (day[ok], reach[ok]), reaches["flows"].combine_chunks().flatten().to_numpy()[ok])
    return m[np.arange(first, end) // 24 - low]


def evaluate(reaches: DataFrame, daily: DataFrame, outlets: DataFrame, observed: DataFrame, start: str, days: int, chunk_days: int = 10, tau: int = 0, paths: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(pairs, scores) of a run: the network routed hour by hour in chunks of days with its state carried over, flows pooled to days that begin ``tau`` hours after midnight, added up at the gauges, and set against the observations.

    ``reaches`` and ``paths`` as for ``Parts``; ``daily``: comid, day, q; ``outlets``: staid, comid; ``observed``: staid, day, obs. The
    first and the last day of the run are left out, as is any day without all of its hours. Inflow goes to the tasks as days, and
    what leaves them are sums over days.
    """
    d = F.datediff("day", F.lit(start).cast("date"))
    own = daily.withColumn("_d", d).filter((F.col("_d") >= 0) & (F.col("_d") < days))
    own = own.groupBy("comid").agg(F.collect_list(F.struct("_d", F.coalesce("q", F.lit(0.0)).alias("q"))).alias("_x")).select("comid", F.col("_x._d").alias("days"), F.col("_x.q").alias("flows"))

    def pool(flows: list[np.ndarray], first: int) -> np.ndarray:
        day = (np.arange(first, first + len(flows[0])) - tau) // 24
        return np.add.reduceat(flows[0], np.flatnonzero(np.diff(day, prepend=day[0] - 1)), axis=0)

    routed = Parts(reaches.join(own, "comid", "left"), paths).keep(outlets).chunks(_hours_of_days, days * 24, chunk_days * 24, pool, **options)
    sums = [r.select("comid", F.posexplode("r").alias("_d", "_s")).withColumn("_d", F.col("_d") + (first - tau) // 24) for first, r in routed]
    if not sums:
        sums = [reaches.sparkSession.createDataFrame([], "comid long, _d int, _s double")]
    whole = (F.col("_d") * 24 + tau >= 0) & (F.col("_d") * 24 + tau + 24 <= days * 24) & (F.col("_d") > 0) & (F.col("_d") < days - 1)
    pooled = functools.reduce(DataFrame.unionByName, sums).filter(whole).join(outlets.select("staid", "comid"), "comid").groupBy("staid", "_d").agg((F.sum("_s") / 24).alias("pred"))
    pred = pooled.select("staid", F.date_add(F.lit(start).cast("date"), F.col("_d")).alias("day"), "pred")
    pairs = pred.join(observed.select("staid", "day", "obs"), ["staid", "day"])
    return pairs, sc.scores(pairs, "staid")


def batches(groups: DataFrame, by: str, size: int, seed: int, epoch: int) -> DataFrame:
    """(by, batch): the groups in a seeded order of this epoch, ``size`` to a batch; a list of basins, so its order is one window."""
    from pyspark.sql import Window

    w = Window.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(by)), F.col(by))
    return groups.select(by).distinct().select(by, F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("batch"))


def train_epochs(groups: DataFrame, by: str, weights: mo.Weights, loss: Callable, epochs: int, batch_size: int, optimizer: mo.Adam | mo.AdaDelta, seed: int = 42, most: float = 1.0,
                 save: str | None = None, resume: bool = False) -> tuple[mo.Weights, list[tuple[int, int, float]]]:
    """Gradient steps over batches of whole groups, epoch by epoch, and (epoch, batch, loss before the step).

    Groups whose observations are all null take no part. With ``save``, weights and optimizer are kept after every epoch and
    ``resume`` goes on after the last one kept, with the same steps as a run that never stopped.
    """
    import os

    done, log = 0, []
    if resume and save and os.path.exists(save):
        weights, done = mo.load_state(save, optimizer)
    seen = groups.filter(F.col("observed").isNotNull() & F.exists("observed", lambda x: x.isNotNull() & ~F.isnan(x))).select(by).distinct()
    known = groups.join(seen, by, "left_semi")
    for epoch in range(done, epochs):
        plan = batches(known, by, batch_size, seed, epoch)
        n = plan.agg(F.max("batch")).first()[0]
        for k in range(-1 if n is None else n + 1):
            value, g = mo.summed_gradient(known.join(plan.filter(F.col("batch") == k).select(by), by, "left_semi"), by, weights, loss)
            log.append((epoch, k, value))
            weights = optimizer.step(weights, mo.clip_norm(g, most))
        if save:
            mo.save_state(save, weights, optimizer, epoch + 1)
    return weights, log


def batch_loss(pairs: DataFrame, kind: str) -> DataFrame:
    """(loss) of the pairs under ``kind``: l1, nse (squared errors in units of the station's spread), hydrograph or components; pairs with a null or NaN do not count."""
    p = pairs.filter(F.col("pred").isNotNull() & F.col("obs").isNotNull() & ~F.isnan("pred") & ~F.isnan("obs"))
    if kind == "l1":
        return p.agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("loss"))
    if kind == "nse":
        sd = p.groupBy("staid").agg((F.stddev_pop("obs") + 0.1).alias("_s"))
        return p.join(sd, "staid").agg(F.avg(F.pow((F.col("pred") - F.col("obs")) / F.col("_s"), 2)).alias("loss"))
    if kind in ("hydrograph", "components"):
        return sc.moments(p, ["staid"]).select((sc.hydrograph_loss() if kind == "hydrograph" else sc.component_loss()).alias("l")).agg(F.avg("l").alias("loss"))
    raise ValueError(f"no loss {kind!r}")
