"""Operators on river graphs: edges, order, cycles, closures, accumulation, subdivision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.physics import DT_SECONDS, reference_celerity
from talweg.operators.flowlines import UPS
from talweg.operators.hierarchy import hierarchy


def upstream_edges(reaches: DataFrame, ups: list[str] | None = None) -> DataFrame:
    """(down, up): the distinct positive entries of the upstream slots; 0, null and negative mean none."""
    return reaches.select(F.col("comid").alias("down"), F.explode(F.array(*(ups or UPS))).alias("up")).filter("up > 0 and down is not null").distinct()


def upstream_lists(edges: DataFrame) -> DataFrame:
    """(down, ups): the sorted upstream reaches of each reach that has some."""
    return edges.groupBy("down").agg(F.array_sort(F.collect_set("up")).alias("ups"))


def invert(edges: DataFrame) -> DataFrame:
    """The edges read the other way."""
    return edges.select(F.col("up").alias("down"), F.col("down").alias("up"))


def dendritic_violations(edges: DataFrame) -> DataFrame:
    """(up, n_down): reaches that flow into more than one reach."""
    return edges.groupBy("up").agg(F.countDistinct("down").alias("n_down")).filter("n_down > 1")


def isolated(reaches: DataFrame, edges: DataFrame) -> DataFrame:
    """Reaches that no edge names."""
    named = edges.select(F.explode(F.array("down", "up")).alias("comid")).distinct()
    return reaches.select("comid").distinct().join(named, "comid", "left_anti")


def on_or_above_loops(links: DataFrame) -> DataFrame:
    """(comid, loop): reaches on a loop or draining into one, with the smallest reach of the loop."""
    return hierarchy(links, "comid", "parent").filter("hops < 0").select(F.col("id").alias("comid"), F.col("root").alias("loop"))


def rings(members: DataFrame) -> DataFrame:
    """(comid, loop): of reaches on or above loops (comid, parent, loop) those on the loop itself.

    The smallest reach of a loop is on it; from there the links are followed by pointer doubling, so a loop of n reaches
    takes log(n) joins.
    """
    from talweg.session import Scratch

    scratch = Scratch(members.sparkSession)
    hop = scratch.save(members.select("comid", "parent"), "hop0")
    on = scratch.save(members.filter("comid = loop").select("comid", "loop"), "on0")
    i = 0
    while True:
        i += 1
        ahead = on.join(hop, "comid").select(F.col("parent").alias("comid"), "loop")
        more = scratch.save(on.unionByName(ahead).distinct(), f"on{i}")
        if more.count() == on.count():
            return more
        on = more
        hop = scratch.save(hop.join(hop.select(F.col("comid").alias("parent"), F.col("parent").alias("_p")), "parent").select("comid", F.col("_p").alias("parent")), f"hop{i}")


def topological_order(links: DataFrame) -> DataFrame:
    """(comid, root, depth, height): depth counts steps to the outlet, height the longest way up to a headwater, sent up while peeling.

    Ordering by height, then comid, puts every reach after all that drain into it, in each basin on its own; no global
    numbering is made, which would need one task.
    """
    good = hierarchy(links, "comid", "parent", sizes=True).filter("hops >= 0")
    return good.select(F.col("id").alias("comid"), "root", F.col("hops").alias("depth"), "height")


def positions(order: DataFrame, basin: str = "root") -> DataFrame:
    """(comid, basin, pos): dense positions in topological order inside each basin."""
    w = Window.partitionBy(basin).orderBy("height", "comid")
    return order.select("comid", F.col(basin).alias("basin"), (F.row_number().over(w) - 1).alias("pos"))


def cut_at(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(comid, source, hops): the first source reach on the way down from each reach, itself included, and the steps to it; reaches with none are left out.

    The links out of the sources are cut, so that the source is the root of its part of the forest.
    """
    at = sources.select(F.col("comid")).filter("comid is not null").distinct().withColumn("_cut", F.lit(True))
    own = links.select("comid", "parent").join(at, "comid", "left").select("comid", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"))
    got = hierarchy(own, "comid", "parent").filter("hops >= 0").select(F.col("id").alias("comid"), F.col("root").alias("source"), "hops")
    return got.join(at.select(F.col("comid").alias("source")), "source", "left_semi").select("comid", "source", "hops")


def source_tree(links: DataFrame, nearest: DataFrame) -> DataFrame:
    """(source, below, hops): every source reach with each source below it, itself at 0 steps; ``nearest`` comes from ``cut_at``.

    The sources make a forest of their own, as deep as they are nested, which is far less than the river is.
    """
    from talweg.session import Scratch

    scratch = Scratch(links.sparkSession)
    sources = nearest.filter("hops = 0").select(F.col("source").alias("comid"))
    after = links.select("comid", "parent").join(sources, "comid", "left_semi")
    step = after.join(nearest.select(F.col("comid").alias("parent"), F.col("source").alias("next"), (F.col("hops") + 1).alias("far")), "parent", "left").select("comid", "next", F.coalesce("far", F.lit(0)).alias("far"))
    step = scratch.save(step, "step")
    paths = hierarchy(step, "comid", "next", with_paths=True).filter("hops >= 0").select(F.col("id").alias("source"), F.explode("path").alias("below"))
    depth = paths.join(step.withColumnRenamed("comid", "below"), "below").groupBy("source").agg(F.sum("far").alias("_d"))
    return paths.join(depth, "source").join(depth.select(F.col("source").alias("below"), F.col("_d").alias("_e")), "below").select("source", "below", (F.col("_d") - F.col("_e")).alias("hops"))


def gauge_reaches(links: DataFrame, gauges: DataFrame) -> DataFrame:
    """(staid, comid, hops): every reach above each gauge's outlet, the outlet included; gauges on unknown reaches have none."""
    own = gauges.select("staid", F.col("comid").alias("below")).filter("below is not null").distinct()
    nearest = cut_at(links, own.select(F.col("below").alias("comid")))
    tree = source_tree(links, nearest).withColumnRenamed("hops", "_more").join(own, "below")
    return nearest.join(tree, "source").select("staid", "comid", (F.col("hops") + F.col("_more")).alias("hops"))


def summed_above(links: DataFrame, gauges: DataFrame, values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(staid, by, total): the sum of ``value`` over all reaches above each gauge, by ``by`` (a day, say).

    Values are added up to the next gauge down the river first, and only those sums are handed on from gauge to gauge.
    """
    own = gauges.select("staid", F.col("comid").alias("below")).filter("below is not null").distinct()
    nearest = cut_at(links, own.select(F.col("below").alias("comid")))
    part = values.join(nearest.select("comid", "source"), "comid").groupBy("source", *by).agg(F.sum(value).alias("_v"))
    tree = source_tree(links, nearest).join(own, "below").select("source", "staid")
    return part.join(tree, "source").groupBy("staid", *by).agg(F.sum("_v").alias("total"))


def gauge_edges(gauge_reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(staid, down, up): the edges inside each gauge's upstream set."""
    have = gauge_reach.select("staid", "comid")
    first = edges.join(have.withColumnRenamed("comid", "down"), "down")
    return first.join(have.withColumnRenamed("comid", "up"), ["staid", "up"]).select("staid", "down", "up")


def union_edges(gauge_edge: DataFrame, staids: DataFrame | None = None) -> DataFrame:
    """The distinct edges of several gauges."""
    own = gauge_edge if staids is None else gauge_edge.join(staids, "staid", "left_semi")
    return own.select("down", "up").distinct()


def compress(gauge_edge: DataFrame, order: DataFrame) -> DataFrame:
    """(staid, pos, comid): dense ids of each gauge's active reaches in topological order."""
    active = gauge_edge.select("staid", F.explode(F.array("down", "up")).alias("comid")).distinct().join(order.select("comid", "height"), "comid")
    w = Window.partitionBy("staid").orderBy("height", "comid")
    return active.select("staid", (F.row_number().over(w) - 1).alias("pos"), "comid")


def outflow_reaches(gauge_edge: DataFrame | None, outlets: DataFrame, legacy: bool = False) -> DataFrame:
    """(staid, comid): whose flow a gauge reads: its own reach, or (legacy, only then the edges are read) the reaches just above it, itself if none."""
    own = outlets.select("staid", F.col("comid").alias("own"))
    if not legacy:
        return own.withColumnRenamed("own", "comid")
    above = gauge_edge.select("staid", F.col("down").alias("own"), F.col("up").alias("comid"))
    return own.join(above, ["staid", "own"], "left").select("staid", F.coalesce("comid", "own").alias("comid"))


def accumulate(links: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(comid, total): each reach's own value plus all above it, sent down the river while peeling; null and absent values count 0.

    Reaches on loops or above them have none.
    """
    own = values.groupBy("comid").agg(F.sum(value).alias("_v"))
    got = hierarchy(links.select("comid", "parent").join(own, "comid", "left"), "comid", "parent", sums={"total": ("_v", None)})
    return got.filter("hops >= 0").select(F.col("id").alias("comid"), "total")


def accumulate_by(paths: DataFrame, values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(comid, by, total): the same by ``by`` (a day, say), for every reach that has a value at it or above; as many rows as values times their depth are added up."""
    up = paths.filter(F.col("path").isNotNull()).select(F.col("id").alias("comid"), F.explode("path").alias("_at"))
    got = up.join(values.select("comid", *by, F.col(value).alias("_v")), "comid")
    return got.groupBy(F.col("_at").alias("comid"), *by).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("total"))


def nearest_source_above(links: DataFrame, sources: DataFrame, unreachable: int = 999_999) -> DataFrame:
    """(comid, distance): steps from each reach down to the nearest source reach on its path, ``unreachable`` if there is none."""
    return links.select("comid").distinct().join(cut_at(links, sources), "comid", "left").select("comid", F.coalesce("hops", F.lit(unreachable)).alias("distance"))


def plan_reaches(reaches: DataFrame, dt: float = DT_SECONDS, max_pieces: int = 8, min_fraction: float = 1.0, max_factor: float = 4.0) -> DataFrame:
    """Adds pieces and length_eff: long reaches are cut at the distance a wave runs in a step, short ones stretched up to it, by ``max_factor`` at most."""
    target = reference_celerity(F.col("uparea_km2"), F.col("slope")) * dt
    raw = F.greatest(F.col("length_m"), F.lit(0.0))
    ceiling = F.when(raw > 0, raw * max_factor).otherwise(F.lit(float("inf")))
    eff = F.greatest(raw, F.least(target * min_fraction, ceiling), F.lit(1.0))
    return reaches.withColumn("length_eff", eff).withColumn("pieces", F.least(F.greatest(F.ceil(F.col("length_eff") / target), F.lit(1)), F.lit(max_pieces)).cast("int"))


def plan_stats(plan: DataFrame) -> DataFrame:
    """One row: counts, nearest-rank quantiles of the stretching factor, total lengths."""
    raw = F.greatest(F.col("length_m"), F.lit(0.0))
    s = plan.withColumn("_f", F.when((F.col("length_eff") > raw + 1e-3) & (raw > 0), F.col("length_eff") / raw))
    return s.agg(
        F.count("*").alias("n"), F.sum("pieces").alias("sum_pieces"), F.count_if(F.col("pieces") > 1).alias("n_split"),
        F.count_if(F.col("length_eff") > raw + 1e-3).alias("n_stretched"), F.max("_f").alias("factor_max"),
        F.sum(raw).alias("length_before"), F.sum("length_eff").alias("length_after"),
    )


def subdivide(plan: DataFrame) -> DataFrame:
    """(comid, piece, n_pieces, length_m): each reach's pieces in flow order, equal in length."""
    return plan.select("comid", F.posexplode(F.sequence(F.lit(1), F.col("pieces"))).alias("piece", "_i"), F.col("pieces").alias("n_pieces"), (F.col("length_eff") / F.col("pieces")).alias("length_m")).drop("_i")


def subdivided_edges(plan: DataFrame, links: DataFrame) -> DataFrame:
    """(down, down_piece, up, up_piece): pieces of a reach in a chain, the last piece of a reach into the first of the next."""
    p = plan.select("comid", "pieces")
    inner = p.filter("pieces > 1").select(F.col("comid").alias("down"), F.explode(F.sequence(F.lit(1), F.col("pieces") - 1)).alias("down_piece"))
    inner = inner.select("down", "down_piece", F.col("down").alias("up"), (F.col("down_piece") - 1).alias("up_piece"))
    outer = links.filter("parent is not null").join(p, "comid").select(F.col("parent").alias("down"), F.lit(0).alias("down_piece"), F.col("comid").alias("up"), (F.col("pieces") - 1).alias("up_piece"))
    return inner.unionByName(outer)


def conflict_rounds(conflicts: DataFrame, nodes: DataFrame, size: str = "size") -> DataFrame:
    """(node, round): no two nodes in conflict (a, b) share a round. Any number of nodes, larger ones first.

    Independent sets: of the nodes without a round those that come before all their open neighbours, by size and then by a
    hash, take at once the first round that no neighbour has. Only numbers of rows reach the driver.
    """
    from talweg.session import Scratch

    scratch = Scratch(nodes.sparkSession)
    both = conflicts.filter("a <> b").select("a", "b").union(conflicts.filter("a <> b").select("b", "a")).distinct()
    both = scratch.save(both.toDF("node", "other"), "both")
    rank = F.struct(F.col(size).cast("double").alias("s"), F.xxhash64("node").alias("h"), F.col("node").alias("i"))
    left = scratch.save(nodes.groupBy("node").agg(F.max(size).alias(size)).select("node", rank.alias("rank"), F.lit(None).cast("int").alias("round")), "open0")
    k = 0
    while left.filter("round is null").limit(1).count():
        k += 1
        near = both.join(left.select(F.col("node").alias("other"), F.col("rank").alias("_r"), F.col("round").alias("_t")), "other")
        seen = near.groupBy("node").agg(F.max(F.when(F.col("_t").isNull(), F.col("_r"))).alias("_open"), F.array_sort(F.collect_set("_t")).alias("_taken"))
        taken = F.coalesce("_taken", F.array().cast("array<int>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))
        first = F.col("_open").isNull() | (F.col("rank") > F.col("_open"))
        left = scratch.save(left.join(seen, "node", "left").select("node", "rank", F.coalesce("round", F.when(first, free)).alias("round")), f"open{k}")
        scratch.drop(f"open{k - 1}")
    return left.select("node", "round")
