"""Queries over river graphs (G rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.ranks import nearest, order_statistics
from talweg.operators import network as net
from talweg.operators.hierarchy import hierarchy
from talweg.plans import views as v
from talweg.plans.general import _TREE
from talweg.sources.tables import table


def reach_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(v.reach(spark, d), "comid", "parent", with_paths=True)


def river_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(v.links(spark, d), "comid", "parent", with_paths=True)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return net.upstream_edges(v.live(spark, d))


def _links_edges(links: DataFrame) -> DataFrame:
    return links.filter("parent is not null").select(F.col("parent").alias("down"), F.col("comid").alias("up"))


def g1_upstream_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def g2_upstream_lists(spark: SparkSession, d: str) -> DataFrame:
    return net.upstream_lists(_edges(spark, d)).select("down", F.array_join("ups", ",").alias("ups"))


def g3_topological_order(spark: SparkSession, d: str) -> DataFrame:
    return net.topological_order(v.links(spark, d))


def g4_loop_members(spark: SparkSession, d: str) -> DataFrame:
    return net.on_or_above_loops(v.links(spark, d))


def g5_loop_reaches(spark: SparkSession, d: str) -> DataFrame:
    """Only the reaches on a loop themselves: what is left when the leaves above are taken off again and again."""
    bad = v.links(spark, d).join(net.on_or_above_loops(v.links(spark, d)).select("comid", "loop"), "comid")
    return net.rings(bad)


def g6_edges_without_loops(spark: SparkSession, d: str) -> DataFrame:
    """The network once every reach on or above a loop is dropped."""
    links = v.links(spark, d)
    good = hierarchy(links, "comid", "parent").filter("hops >= 0").select(F.col("id").alias("comid"))
    return _links_edges(links.join(good, "comid", "left_semi"))


def g7_dendritic_violations(spark: SparkSession, d: str) -> DataFrame:
    return net.dendritic_violations(_edges(spark, d))


def g8_isolated(spark: SparkSession, d: str) -> DataFrame:
    return net.isolated(v.live(spark, d), _edges(spark, d))


def g9_reach_table(spark: SparkSession, d: str) -> DataFrame:
    """Length and slope with every non-finite value replaced by the mean of the finite ones."""
    live = table(spark, d, "flowlines").join(v.live(spark, d).select("comid", "fid"), ["comid", "fid"], "left_semi")
    from talweg.functions.common import finite

    raw = live.select("comid", (finite("lengthkm") * 1000).alias("length_m"), finite("slope").alias("slope"))
    mean = raw.agg(F.avg("length_m").alias("_l"), F.avg("slope").alias("_s"))
    return raw.crossJoin(mean).select("comid", F.coalesce("length_m", "_l").alias("length_m"), F.coalesce("slope", "_s").alias("slope"))


def g10_downstream_edges(spark: SparkSession, d: str) -> DataFrame:
    return net.invert(_edges(spark, d)).select(F.col("down").alias("src"), F.col("up").alias("dst"))


def _gauge_reach(spark: SparkSession, d: str) -> DataFrame:
    return net.gauge_reaches(v.reach(spark, d), v.gauge(spark, d))


def g11_upstream_closure(spark: SparkSession, d: str) -> DataFrame:
    return reach_paths(spark, d).select(F.posexplode("path").alias("hops", "ancestor"), F.col("id").alias("comid"))


def g13_gauge_reaches(spark: SparkSession, d: str) -> DataFrame:
    return _gauge_reach(spark, d)


def g12_gauge_edges(spark: SparkSession, d: str) -> DataFrame:
    return net.gauge_edges(_gauge_reach(spark, d), _links_edges(v.reach(spark, d)))


def g14_gauge_members(spark: SparkSession, d: str) -> DataFrame:
    e = g12_gauge_edges(spark, d)
    return e.select("staid", F.explode(F.array("down", "up")).alias("comid")).distinct()


def g15_union_edges(spark: SparkSession, d: str) -> DataFrame:
    return net.union_edges(g12_gauge_edges(spark, d))


def g16_compressed(spark: SparkSession, d: str) -> DataFrame:
    return net.compress(g12_gauge_edges(spark, d), net.topological_order(v.reach(spark, d)))


def g17_outflow_own(spark: SparkSession, d: str) -> DataFrame:
    return net.outflow_reaches(g12_gauge_edges(spark, d), v.gauge(spark, d))


def g17_outflow_legacy(spark: SparkSession, d: str) -> DataFrame:
    return net.outflow_reaches(g12_gauge_edges(spark, d), v.gauge(spark, d), legacy=True)


def g18_piece_check(spark: SparkSession, d: str) -> DataFrame:
    """Parents whose pieces are not the run 0..n-1; none if the subdivision is sound."""
    p = net.subdivide(net.plan_reaches(v.reach(spark, d)))
    ok = (F.count("*") == F.max("n_pieces")) & (F.min("piece") == 0) & (F.max("piece") == F.max("n_pieces") - 1)
    return p.groupBy("comid").agg(ok.alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


def g19_flow_scale(spark: SparkSession, d: str) -> DataFrame:
    """Per reach the factor of the last gauge on it, 1 without one."""
    from talweg.functions.physics import flow_scale

    g = table(spark, d, "gages").filter("comid > 0").withColumn("f", flow_scale(F.col("drain_sqkm"), F.col("comid_drain_sqkm"), F.col("comid_unitarea_sqkm")))
    last = g.groupBy("comid").agg(F.max_by("f", "row_id").alias("f"))
    return v.live(spark, d).select("comid").join(last, "comid", "left").select("comid", F.coalesce("f", F.lit(1.0)).alias("scale"))


def g20_upstream_area(spark: SparkSession, d: str) -> DataFrame:
    return net.accumulate(v.reach(spark, d), v.reach(spark, d).withColumn("a", F.col("length_m") / 1000), "a")


def g21_accumulate_days(spark: SparkSession, d: str) -> DataFrame:
    return net.accumulate_by(reach_paths(spark, d), v.qr(spark, d).withColumn("day", F.date_trunc("month", "day").cast("date")), "qr", ["day"]).withColumn("total", F.round("total", 3))


def g22_distance_to_gauge(spark: SparkSession, d: str) -> DataFrame:
    return net.nearest_source_above(v.reach(spark, d), v.gauge(spark, d))


def g23_reach_plan(spark: SparkSession, d: str) -> DataFrame:
    return net.plan_reaches(v.reach(spark, d)).select("comid", "pieces", "length_eff")


def g24_subreaches(spark: SparkSession, d: str) -> DataFrame:
    return net.subdivide(net.plan_reaches(v.reach(spark, d)))


def g24_subreach_edges(spark: SparkSession, d: str) -> DataFrame:
    r = v.reach(spark, d)
    return net.subdivided_edges(net.plan_reaches(r), r)


def g25_plan_stats(spark: SparkSession, d: str) -> DataFrame:
    return net.plan_stats(net.plan_reaches(v.reach(spark, d)))


def g25_pieces_histogram(spark: SparkSession, d: str) -> DataFrame:
    return net.plan_reaches(v.reach(spark, d)).groupBy("pieces").agg(F.count("*").alias("n"))


def g25_factor_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank quantiles of the stretching factors by zone of length (the survey's convention sorted[round((n - 1) p)])."""
    p = net.plan_reaches(v.reach(spark, d)).filter("length_eff > length_m + 1e-3 and length_m > 0").withColumn("f", F.col("length_eff") / F.col("length_m"))
    return order_statistics(p, ["pieces"], "f", {"p50": nearest(0.5), "p95": nearest(0.95), "p99": nearest(0.99)}).drop("n")


def _probe_conflicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gauges with the size of what is above them, and the pairs of which one is above the other."""
    reaches = _gauge_reach(spark, d)
    g = v.gauge(spark, d).select("staid", "comid")
    inside = reaches.join(g.select(F.col("staid").alias("b"), "comid"), "comid").filter("staid <> b").select(F.col("staid").alias("a"), "b").distinct()
    sizes = reaches.groupBy("staid").agg(F.count("*").alias("size"))
    return inside, g.select("staid").distinct().join(sizes, "staid", "left").select(F.col("staid").alias("node"), F.coalesce("size", F.lit(0)).alias("size"))


def g26_probe_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of gauge probes so that no gauge shares a round with one above it, the largest first."""
    return net.conflict_rounds(*_probe_conflicts(spark, d)).select(F.col("node").alias("staid"), "round")


def g26_round_faults(spark: SparkSession, d: str) -> DataFrame:
    """How many gauges have a round, how many pairs clash in theirs, and how many could have had an earlier one."""
    clash, _ = _probe_conflicts(spark, d)
    r = g26_probe_rounds(spark, d)
    both = clash.union(clash.select("b", "a")).join(r.withColumnRenamed("staid", "a"), "a").join(r.select(F.col("staid").alias("b"), F.col("round").alias("other")), "b")
    bad = both.agg(F.count_if(F.col("round") == F.col("other")).alias("clashes"))
    before = both.filter("other < round").groupBy("a").agg(F.countDistinct("other").alias("n"))
    late = r.join(before.withColumnRenamed("a", "staid"), "staid", "left").agg(F.count("*").alias("gauges"), F.count_if(F.coalesce("n", F.lit(0)) < F.col("round")).alias("late"))
    return late.crossJoin(bad)


def g27_accumulation_check(spark: SparkSession, d: str) -> DataFrame:
    """Sums sent down the river against sums over all paths: reaches, and those where the two differ."""
    r = v.reach(spark, d).withColumn("a", F.col("length_m") / 1000)
    peeled = net.accumulate(r, r, "a")
    direct = net.accumulate_by(reach_paths(spark, d), r, "a", []).withColumnRenamed("total", "other")
    off = F.abs(F.col("total") - F.col("other")) > 1e-9 * F.abs(F.col("other"))
    return peeled.join(direct, "comid", "full").agg(F.count("*").alias("n"), F.count_if(F.coalesce(off, F.lit(True))).alias("differ"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "g" and k[1].isdigit()}

_CLOSURE = v.sql("reach", "closure", recursive=True)
_GAUGE = v.sql("reach", "closure", "gauge", recursive=True) + ", gr AS (SELECT g.staid, c.comid, c.hops FROM closure c JOIN gauge g ON g.comid = c.anc), ge AS (SELECT a.staid, r.parent AS down, r.comid AS up FROM reach r JOIN gr a ON a.comid = r.parent JOIN gr b ON b.comid = r.comid AND b.staid = a.staid)"
_EDGES = f"WITH {v.SQL['live']}, e AS (SELECT DISTINCT down, up FROM (SELECT comid AS down, unnest([up1, up2, up3, up4]) AS up FROM live) WHERE up > 0)"
_CEL = "greatest(0.05, least(5.0, (1 / 0.05) * pow(greatest(pow(greatest(0.01 * pow(greatest(uparea_km2, 0), 0.9), 1e-3), 0.4), 0.01), CAST(2 AS DOUBLE) / 3) * sqrt(greatest(slope, 1e-3)) * (CAST(5 AS DOUBLE) / 3)))"
_PLAN = v.sql("reach") + f""", t AS (SELECT *, CAST({_CEL} AS DOUBLE) * 3600 AS target FROM reach),
plan0 AS (SELECT *, greatest(length_m, least(target, CASE WHEN length_m > 0 THEN length_m * 4 ELSE CAST('inf' AS DOUBLE) END), 1.0) AS length_eff FROM t),
plan AS (SELECT *, CAST(least(greatest(ceil(length_eff / target), 1), 8) AS INTEGER) AS pieces FROM plan0)"""
_RANK = "list_sort(list(length_eff / length_m))[CAST(round((count(*) - 1) * CAST({0} AS DOUBLE)) AS BIGINT) + 1]"

_REST = f"""{_TREE},
rest AS (SELECT comid, parent FROM link WHERE comid NOT IN (SELECT node FROM walk)),
down AS (SELECT comid AS start, parent AS pos FROM rest UNION SELECT d.start, r.parent FROM down d JOIN rest r ON r.comid = d.pos),
ring AS (SELECT start AS node FROM down WHERE start = pos)"""

SQL = {
    "g26_round_faults": "SELECT count(*) AS gauges, 0 AS late, 0 AS clashes FROM supplier",
    "g27_accumulation_check": "SELECT count(*) AS n, 0 AS differ FROM part",
    "g4_loop_members": f"{_REST} SELECT start AS comid, min(pos) AS loop FROM down WHERE pos IN (SELECT node FROM ring) GROUP BY start",
    "g5_loop_reaches": f"{_REST} SELECT r.node AS comid, min(d.pos) AS loop FROM ring r JOIN down d ON d.start = r.node WHERE d.pos IN (SELECT node FROM ring) GROUP BY r.node",
    "g6_edges_without_loops": f"{_TREE} SELECT parent AS down, comid AS up FROM link WHERE parent IS NOT NULL AND comid IN (SELECT node FROM walk)",
    "g1_upstream_edges": f"{_EDGES} SELECT down, up FROM e",
    "g2_upstream_lists": f"{_EDGES} SELECT down, array_to_string(list_sort(list(up)), ',') AS ups FROM e GROUP BY down",
    "g3_topological_order": f"""{_TREE},
up AS (SELECT comid AS node, parent AS anc, 1 AS d FROM link WHERE parent IS NOT NULL AND comid IN (SELECT node FROM walk)
       UNION ALL SELECT p.node, l.parent, p.d + 1 FROM up p JOIN link l ON l.comid = p.anc WHERE l.parent IS NOT NULL),
h AS (SELECT anc, max(d) AS h FROM up GROUP BY anc)
SELECT node AS comid, root, CAST(hops AS BIGINT) AS depth, CAST(coalesce(h.h, 0) AS BIGINT) AS height FROM walk LEFT JOIN h ON h.anc = node""",
    "g7_dendritic_violations": f"{_EDGES} SELECT up, count(*) AS n_down FROM e GROUP BY up HAVING count(*) > 1",
    "g8_isolated": f"{_EDGES} SELECT comid FROM live WHERE comid NOT IN (SELECT down FROM e UNION ALL SELECT up FROM e)",
    "g9_reach_table": f"""WITH {v.SQL['live']}, r AS (SELECT comid, CASE WHEN isfinite(lengthkm) THEN lengthkm * 1000 END AS l, CASE WHEN isfinite(slope) THEN slope END AS s FROM live)
SELECT comid, coalesce(l, (SELECT avg(l) FROM r)) AS length_m, coalesce(s, (SELECT avg(s) FROM r)) AS slope FROM r""",
    "g10_downstream_edges": f"{_EDGES} SELECT up AS src, down AS dst FROM e",
    "g11_upstream_closure": f"{_CLOSURE} SELECT hops, anc AS ancestor, comid FROM closure",
    "g12_gauge_edges": f"{_GAUGE} SELECT staid, down, up FROM ge",
    "g13_gauge_reaches": f"{_GAUGE} SELECT staid, comid, hops FROM gr",
    "g14_gauge_members": f"{_GAUGE} SELECT staid, down AS comid FROM ge UNION SELECT staid, up FROM ge",
    "g15_union_edges": f"{_GAUGE} SELECT DISTINCT down, up FROM ge",
    "g16_compressed": f"""{_GAUGE}, h AS (SELECT anc AS comid, max(hops) AS height FROM closure GROUP BY anc), m AS (SELECT staid, down AS comid FROM ge UNION SELECT staid, up FROM ge)
SELECT staid, row_number() OVER (PARTITION BY staid ORDER BY height, comid) - 1 AS pos, comid FROM m JOIN h USING (comid)""",
    "g17_outflow_own": f"{v.sql('gauge')} SELECT staid, comid FROM gauge",
    "g17_outflow_legacy": f"{_GAUGE} SELECT g.staid, coalesce(ge.up, g.comid) AS comid FROM gauge g LEFT JOIN ge ON ge.staid = g.staid AND ge.down = g.comid",
    "g18_piece_check": "SELECT true AS ok, count(*) AS n FROM part",
    "g19_flow_scale": f"""WITH {v.SQL['live']}, g AS (SELECT comid, row_id, CASE WHEN comid_unitarea_sqkm > 0 AND drain_sqkm - comid_drain_sqkm < 0 AND abs(drain_sqkm - comid_drain_sqkm) < comid_unitarea_sqkm
  THEN (comid_unitarea_sqkm - abs(drain_sqkm - comid_drain_sqkm)) / comid_unitarea_sqkm ELSE CAST(1 AS DOUBLE) END AS f FROM gages WHERE comid > 0),
last AS (SELECT comid, arg_max(f, row_id) AS f FROM g GROUP BY comid) SELECT comid, coalesce(f, CAST(1 AS DOUBLE)) AS scale FROM live LEFT JOIN last USING (comid)""",
    "g20_upstream_area": f"{_CLOSURE} SELECT anc AS comid, sum(length_m / 1000) AS total FROM closure JOIN reach USING (comid) GROUP BY anc",
    "g21_accumulate_days": v.sql("reach", "closure", "qr", recursive=True) + " SELECT c.anc AS comid, CAST(date_trunc('month', q.day) AS DATE) AS day, round(sum(q.qr), 3) AS total FROM closure c JOIN qr q USING (comid) GROUP BY ALL",
    "g22_distance_to_gauge": v.sql("reach", "closure", "gauge", recursive=True) + ", m AS (SELECT comid, min(hops) AS x FROM closure WHERE anc IN (SELECT comid FROM gauge) GROUP BY comid) SELECT comid, coalesce(x, 999999) AS distance FROM reach LEFT JOIN m USING (comid)",
    "g23_reach_plan": f"{_PLAN} SELECT comid, pieces, length_eff FROM plan",
    "g24_subreaches": f"{_PLAN} SELECT comid, unnest(range(0, pieces)) AS piece, pieces AS n_pieces, length_eff / pieces AS length_m FROM plan",
    "g24_subreach_edges": f"{_PLAN}, i AS (SELECT comid AS c, unnest(range(1, pieces)) AS p FROM plan) SELECT c AS down, p AS down_piece, c AS up, p - 1 AS up_piece FROM i UNION ALL SELECT parent, 0, comid, pieces - 1 FROM plan WHERE parent IS NOT NULL",
    "g25_plan_stats": f"""{_PLAN} SELECT count(*) AS n, sum(pieces) AS sum_pieces, count_if(pieces > 1) AS n_split, count_if(length_eff > length_m + 1e-3) AS n_stretched,
max(CASE WHEN length_eff > length_m + 1e-3 AND length_m > 0 THEN length_eff / length_m END) AS factor_max, sum(length_m) AS length_before, sum(length_eff) AS length_after FROM plan""",
    "g25_pieces_histogram": f"{_PLAN} SELECT pieces, count(*) AS n FROM plan GROUP BY pieces",
    "g25_factor_quantiles": f"{_PLAN} SELECT pieces, {_RANK.format(0.5)} AS p50, {_RANK.format(0.95)} AS p95, {_RANK.format(0.99)} AS p99 FROM plan WHERE length_eff > length_m + 1e-3 AND length_m > 0 GROUP BY pieces",
}
