"""Muskingum-Cunge routing of whole basins, in one grouped map or in bands of sub-basins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.physics import FROZEN
from talweg.functions.recurrence import Network, route
from talweg.operators.hierarchy import hierarchy
from talweg.session import Scratch

#: Reaches that one call of the recurrence takes at least, if they are there: small basins are routed together.
GROUP_REACHES = 4000
#: A basin of more reaches than this is cut into sub-basins.
WHOLE_REACHES = 200_000
OUT = "comid long, t int, q double"


def _arrays(reaches: pd.DataFrame) -> tuple[pd.Index, Network, dict]:
    reaches = reaches.sort_values("comid", ignore_index=True)
    ids = pd.Index(reaches["comid"])
    par = reaches["parent"].fillna(-1).astype("int64")
    net = Network(ids.get_indexer(par))
    own = {k: reaches[k].to_numpy("f8") if k in reaches else np.full(len(ids), v) for k, v in FROZEN.items()}
    return ids, net, {"params": own, "length": reaches["length_m"].to_numpy("f8"), "slope": reaches["slope"].to_numpy("f8"), "pieces": reaches["pieces"].to_numpy("f8") if "pieces" in reaches else 1.0}


def _matrix(rows: pd.DataFrame, ids: pd.Index, steps: int, value: str) -> np.ndarray:
    m = np.zeros((steps, len(ids)))
    at = ids.get_indexer(rows["comid"])
    ok = at >= 0
    np.add.at(m, (rows["t"].to_numpy()[ok], at[ok]), rows[value].to_numpy("f8")[ok])
    return m


def route_group(reaches: pd.DataFrame, forcing: pd.DataFrame, steps: int, **options) -> pd.DataFrame:
    """Route one group of reaches; ``forcing`` has rows (comid, t, q_lateral, q_boundary). A column ``q_start`` of the reaches is the state to start from; with a boolean column ``keep`` only the flow of those reaches comes out."""
    if not len(reaches):
        return pd.DataFrame({"comid": [], "t": [], "q": []})
    ids, net, own = _arrays(reaches)
    forcing = forcing.fillna({"q_lateral": 0.0, "q_boundary": 0.0})
    if "q_start" in reaches:
        options = options | {"start": reaches.set_index("comid")["q_start"].reindex(ids).to_numpy("f8")}
    qs = route(net, _matrix(forcing, ids, steps, "q_lateral"), own["params"], own["length"], own["slope"], pieces=own["pieces"], boundary=_matrix(forcing, ids, steps, "q_boundary"), **options)
    q = np.stack([x.value for x in qs])
    if "keep" in reaches:
        kept = reaches.set_index("comid")["keep"].reindex(ids).to_numpy(bool)
        ids, q = ids[kept], q[:, kept]
    return pd.DataFrame({"comid": np.tile(ids.to_numpy(), steps), "t": np.repeat(np.arange(steps), len(ids)), "q": q.ravel()})


def _bucket(key: str, reaches: int) -> Column:
    """Whole basins or parts together in groups of about ``GROUP_REACHES``; a network may be a forest."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(max(1, -(-reaches // GROUP_REACHES))))


def route_basins(reaches: DataFrame, forcing: DataFrame, steps: int, basin: str = "basin", **options) -> DataFrame:
    """(comid, t, q): every basin whole in one task. ``reaches``: basin, comid, parent, length_m, slope and any of n, q_spatial, p_spatial, pieces; ``forcing``: comid, t in [0, steps), q_lateral.

    Reaches without forcing get the floor; a loop is an error. For basins that outgrow a task use ``route_in_bands``.
    """
    reaches = reaches.withColumn("_group", _bucket(basin, reaches.count()))
    keyed = forcing.join(reaches.select("comid", F.col("_group").alias("_to")), "comid").withColumn("q_boundary", F.lit(0.0))
    fn = lambda key, r, f: route_group(r, f, steps, **options)
    return reaches.groupBy("_group").cogroup(keyed.groupBy("_to")).applyInPandas(fn, OUT)


def route_chunks(reaches: DataFrame, forcing: DataFrame, steps: int, chunk: int, keep: DataFrame | None = None, **options) -> DataFrame:
    """(comid, t, q) of ``route_basins``, ``chunk`` hours at a time: the state at the end of a chunk starts the next, so a run of years needs the memory of a chunk.

    ``keep`` (comid): whose flow is kept; of the others only the last hour of a chunk is written.
    """
    scratch = Scratch(reaches.sparkSession)
    own = reaches.withColumn("keep", F.lit(True))
    names: list[str] = []
    state: DataFrame | None = None
    for first in range(0, steps, chunk):
        begin, end = max(first - 1, 0), min(first + chunk, steps)
        part = forcing.filter((F.col("t") >= begin) & (F.col("t") < end)).withColumn("t", F.col("t") - begin)
        net = own if state is None else own.join(state, "comid")
        got = route_basins(net, part, end - begin, **options).withColumn("t", F.col("t") + begin).filter(F.col("t") >= first)
        got = scratch.save(got, f"whole{first}")
        state = scratch.save(got.filter(F.col("t") == end - 1).select("comid", F.col("q").alias("q_start")), f"state{first}")
        names.append(f"whole{first}")
        if keep is not None:
            scratch.save(got.join(keep.select("comid").distinct(), "comid", "left_semi"), f"kept{first}")
            scratch.drop(f"whole{first}")
            names[-1] = f"kept{first}"
    return scratch.read(*names, schema=OUT) if names else reaches.sparkSession.createDataFrame([], OUT)


def route_network(reaches: DataFrame, forcing: DataFrame, steps: int, most: int = WHOLE_REACHES, height: int = 64, **options) -> DataFrame:
    """(comid, t, q) by whichever way fits: whole basins where none has more than ``most`` reaches, else sub-basins in bands.

    ``reaches``: comid, parent and the rest as for ``route_basins``; the basins come from the links.
    """
    scratch = Scratch(reaches.sparkSession)
    tops = scratch.save(hierarchy(reaches, "comid", "parent").select(F.col("id").alias("comid"), F.col("root").alias("basin"), "hops"), "tops")
    if tops.filter("hops < 0").limit(1).count():
        raise ValueError("the network has a loop")
    largest = tops.groupBy("basin").count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return route_basins(reaches.drop("basin").join(tops.select("comid", "basin"), "comid"), forcing, steps, **options)
    return route_in_bands(reaches.drop("basin"), forcing, hierarchy(reaches, "comid", "parent", with_paths=True), steps, height, **options)


def bands(paths: DataFrame, height: int) -> DataFrame:
    """(comid, band, part): sub-basins of at most ``height`` reaches in depth. Band b holds the reaches b * height or more, under (b + 1) * height, steps from the outlet."""
    good = paths.filter("hops >= 0")
    band = F.floor(F.col("hops") / height)
    return good.select(F.col("id").alias("comid"), band.cast("int").alias("band"), F.get("path", (F.col("hops") - band * height).cast("int")).alias("part"))


def route_in_bands(reaches: DataFrame, forcing: DataFrame, paths: DataFrame, steps: int, height: int = 64, **options) -> DataFrame:
    """The same result for basins of any size: sub-basins of a band are routed side by side, bands from the headwaters down.

    No upstream flow ever depends on a downstream one, so the hydrograph at the mouth of a sub-basin is all that the next
    band needs: its flow of this step and of the next enters the receiving reach. There are depth / height bands.
    """
    spark, scratch = reaches.sparkSession, Scratch(reaches.sparkSession)
    where = scratch.save(bands(paths, height), "bands")
    top = where.agg(F.max("band")).first()[0]
    own = scratch.save(reaches.join(where, "comid"), "own")
    sizes = {r["band"]: r["count"] for r in own.groupBy("band").count().collect()}
    names: list[str] = []
    fn = lambda key, r, f: route_group(r, f, steps, **options)
    for b in range(top if top is not None else -1, -1, -1):
        here = own.filter(F.col("band") == b).withColumn("_group", _bucket("part", sizes[b]))
        drive = forcing.select("comid", "t", "q_lateral", F.lit(0.0).alias("q_boundary"))
        if names:
            mouths = own.filter((F.col("band") == b + 1) & (F.col("comid") == F.col("part"))).select("comid", "parent")
            flow = scratch.read(names[-1], schema=OUT).join(mouths, "comid")
            drive = drive.unionByName(flow.select(F.col("parent").alias("comid"), "t", F.lit(0.0).alias("q_lateral"), F.col("q").alias("q_boundary")))
        keyed = drive.join(here.select("comid", F.col("_group").alias("_to")), "comid")
        scratch.save(here.groupBy("_group").cogroup(keyed.groupBy("_to")).applyInPandas(fn, OUT), f"band{b}")
        names.append(f"band{b}")
    return scratch.read(*names, schema=OUT) if names else spark.createDataFrame([], OUT)


def one_step_closed_form(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(comid, x, weight): the triangular solve x_i = b_i + c1_i * sum of upstream x, and the weight that b_i has at the outlet, the transposed solve.

    ``links``: comid, parent; ``rows``: comid, b, c1. The sums go down the river while its forest is peeled, so rounds grow
    with log(reaches), and no path is written out.
    """
    own = links.select("comid", "parent").join(rows.select("comid", "b", "c1"), "comid")
    got = hierarchy(own, "comid", "parent", sums={"x": ("b", "c1")}).filter("hops >= 0")
    return got.select(F.col("id").alias("comid"), "x", F.col("x_gain").alias("weight"))


def gauge_flow(flow: DataFrame, outlets: DataFrame) -> DataFrame:
    """(staid, t, q): the flow of each gauge's outflow reaches, added up."""
    return flow.join(outlets.select("staid", "comid"), "comid").groupBy("staid", "t").agg(F.sum("q").alias("q"))


def route_variants(reaches: DataFrame, forcing: DataFrame, steps: int, variants: DataFrame, basin: str = "basin", **options) -> DataFrame:
    """(variant, comid, t, q): the network routed once per variant, all of them in one job.

    ``variants`` (variant long, comid, n_factor[, p_factor]): per variant the reaches whose roughness is scaled; a null comid
    scales all, there also the width parameter if ``p_factor`` is given. A list of bounded size, written by hand or by a plan. A reach gets a number of its own in each variant.
    """
    listed = variants.select("variant").distinct()
    width = reaches.agg(F.max("comid")).first()[0] + 1
    own = reaches.crossJoin(F.broadcast(listed))
    scale = variants.filter("comid is not null").groupBy("variant", "comid").agg(F.max("n_factor").alias("_f"))
    wide = F.max("p_factor") if "p_factor" in variants.columns else F.lit(1.0)
    whole = variants.filter("comid is null").groupBy("variant").agg(F.max("n_factor").alias("_w"), wide.alias("_p"))
    p = F.col("p_spatial") if "p_spatial" in reaches.columns else F.lit(FROZEN["p_spatial"])
    n = F.col("n") if "n" in reaches.columns else F.lit(FROZEN["n"])
    own = own.join(scale, ["variant", "comid"], "left").join(F.broadcast(whole), "variant", "left").withColumns({"n": n * F.coalesce("_f", "_w", F.lit(1.0)), "p_spatial": p * F.coalesce("_p", F.lit(1.0))}).drop("_f", "_w", "_p")
    shift = F.col("variant") * width
    own = own.withColumns({"comid": F.col("comid") + shift, "parent": F.col("parent") + shift, basin: F.struct(F.col("variant"), F.col(basin)).cast("string")})
    drive = forcing.crossJoin(F.broadcast(listed)).withColumn("comid", F.col("comid") + shift).drop("variant")
    got = route_basins(own, drive, steps, basin, **options)
    return got.select(F.floor(F.col("comid") / width).alias("variant"), F.pmod("comid", F.lit(width)).alias("comid"), "t", "q")
