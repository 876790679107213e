import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from talweg.functions.common import nearest_rank, upper_median
from talweg.operators import network as net
from talweg.operators import relational as rel
from talweg.operators import scores as sc
from talweg.operators import series as se
from talweg.operators.hierarchy import hierarchy


def reaches(spark, rows):
    return spark.createDataFrame(rows, "comid long, up1 long, up2 long, up3 long, up4 long")


def test_edges_of_chain_confluence_and_isolated(spark):
    r = reaches(spark, [(20, 10, 0, 0, 0), (10, 0, 0, 0, 0), (30, 20, 20, None, -1), (99, 0, 0, 0, 0), (5, None, None, None, None)])
    e = net.upstream_edges(r)
    assert sorted(map(tuple, e.collect())) == [(20, 10), (30, 20)]
    assert sorted(x[0] for x in net.isolated(r, e).collect()) == [5, 99]
    assert net.dendritic_violations(e).count() == 0
    two = net.upstream_edges(reaches(spark, [(20, 10, 0, 0, 0), (30, 10, 0, 0, 0)]))
    assert [tuple(x) for x in net.dendritic_violations(two).collect()] == [(10, 2)]


def test_order_closure_accumulation_and_distance(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (9, None)], "comid long, parent long")
    order = {r.comid: (r.depth, r.height) for r in net.topological_order(links).collect()}
    assert order == {1: (0, 2), 2: (1, 0), 3: (1, 1), 4: (2, 0), 9: (0, 0)}
    pos = {r.comid: r.pos for r in net.positions(net.topological_order(links)).collect()}
    assert all(pos[a] < pos[b] for a, b in [(2, 1), (4, 3), (3, 1)])
    values = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, None), (4, 100.0)], "comid long, v double")
    assert {r.comid: r.total for r in net.accumulate(links, values, "v").collect()} == {1: 111.0, 2: 10.0, 3: 100.0, 4: 100.0, 9: 0.0}
    two = values.withColumn("day", F.lit(1)).unionByName(values.filter("comid = 4").withColumn("day", F.lit(2)))
    by = net.accumulate_by(hierarchy(links, "comid", "parent", with_paths=True), two, "v", ["day"])
    assert {(r.comid, r.day): r.total for r in by.collect()} == {(1, 1): 111.0, (2, 1): 10.0, (3, 1): 100.0, (4, 1): 100.0, (1, 2): 100.0, (3, 2): 100.0, (4, 2): 100.0}
    d = {r.comid: r.distance for r in net.nearest_source_above(links, spark.createDataFrame([(1,), (3,)], "comid long")).collect()}
    assert d == {1: 0, 2: 1, 3: 0, 4: 1, 9: 999_999}
    gauges = spark.createDataFrame([("a", 3), ("b", 1), ("c", 77), ("d", None)], "staid string, comid long")
    gr = net.gauge_reaches(links, gauges)
    assert {tuple(r) for r in gr.collect()} == {("a", 3, 0), ("a", 4, 1), ("b", 1, 0), ("b", 2, 1), ("b", 3, 1), ("b", 4, 2)}
    sums = net.summed_above(links, gauges, two, "v", ["day"])
    assert {tuple(r) for r in sums.collect()} == {("a", 1, 100.0), ("b", 1, 111.0), ("a", 2, 100.0), ("b", 2, 100.0)}
    edges = links.filter("parent is not null").select(F.col("parent").alias("down"), F.col("comid").alias("up"))
    ge = net.gauge_edges(gr, edges)
    assert {tuple(r) for r in ge.collect()} == {("a", 3, 4), ("b", 1, 2), ("b", 1, 3), ("b", 3, 4)}
    assert net.union_edges(ge).count() == 3
    legacy = {(r.staid, r.comid) for r in net.outflow_reaches(ge, gauges.filter("staid < 'd'"), legacy=True).collect()}
    assert legacy == {("a", 4), ("b", 2), ("b", 3), ("c", 77)}


def test_subdivision_keeps_length_and_runs(spark):
    r = spark.createDataFrame([(i, i // 2 or None, float(50 * 3**i), 0.001 * i, 10.0 * i) for i in range(1, 9)], "comid long, parent long, length_m double, slope double, uparea_km2 double")
    plan = net.plan_reaches(r)
    assert plan.filter("pieces < 1 or pieces > 8 or length_eff < length_m or length_eff > greatest(4 * length_m, 1)").count() == 0
    p = net.subdivide(plan).groupBy("comid").agg(F.sum("length_m").alias("l"), F.count("*").alias("n")).join(plan, "comid")
    assert p.filter("abs(l - length_eff) > 1e-6 or n <> pieces").count() == 0
    assert net.subdivided_edges(plan, r).count() == plan.agg(F.sum(F.col("pieces") - 1)).first()[0] + 7
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4)], "a long, b long")
    nodes = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 1)], "node long, size long")
    assert {tuple(x) for x in net.conflict_rounds(pairs, nodes).collect()} == {(2, 0), (1, 1), (3, 1), (4, 0)}
    star = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)], "a long, b long")
    got = {r.node: r["round"] for r in net.conflict_rounds(star, spark.range(30).select(F.col("id").alias("node"), F.lit(1).alias("size"))).collect()}
    assert len(got) == 30 and all(got[a] != got[b] for a, b in [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)])


def test_scores_by_hand(spark):
    same = [("p", float(i), float(i)) for i in range(1, 101)]
    rows = same + [("b", 2.0 * i, float(i)) for i in range(1, 5)] + [("n", float("nan"), 1.0), ("n", None, 2.0), ("c", 1.0, 3.0), ("c", 2.0, 3.0)]
    got = {r.g: r for r in sc.scores(spark.createDataFrame(rows, "g string, pred double, obs double"), "g").collect()}
    assert (got["p"].nse, got["p"].rmse, got["p"].fhv, got["p"].flv) == (1, 0, 0, 0) and got["p"].kge == pytest.approx(1)
    assert got["b"].bias == pytest.approx(2.5)
    assert got["n"].nse is None and got["n"].bias is None
    assert got["c"].nse is None and got["c"].kge is None and got["c"].rmse == pytest.approx(np.sqrt(2.5))


def test_component_loss_by_hand(spark):
    df = spark.createDataFrame([(1.5, 1.0), (2.5, 3.0), (1.5, 1.0), (2.5, 3.0)], "pred double, obs double").withColumn("g", F.lit(1))
    m = sc.moments(df, ["g"])
    assert m.select(sc.hydrograph_loss(eps=0.0).alias("l")).first().l == pytest.approx(0.7)


def test_percentile_conventions(spark):
    r = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([],), ([5.0],)], "v array<double>").select(upper_median(F.col("v")).alias("m"), nearest_rank(F.col("v"), 0.5).alias("r")).collect()
    assert [(x.m, x.r) for x in r] == [(3.0, 3.0), (None, None), (5.0, 5.0)]


def days(spark, rows):
    return spark.createDataFrame([(i, dt.date(2024, 1, d), v) for i, d, v in rows], "id int, day date, v double")


def test_upsampling(spark):
    d = days(spark, [(1, 1, 10.0), (1, 2, 20.0), (1, 4, 5.0)])
    assert se.to_hourly(d, "id", "day", "v").count() == 72
    lin = {(r.day.day, r.hour): r.v for r in se.to_hourly(d, "id", "day", "v", "linear").collect()}
    assert lin[1, 0] == 10 and lin[1, 23] == pytest.approx(10 + 10 * (23.5 / 24 - 0.5)) and lin[2, 0] == pytest.approx(10 + 10 * (0.5 + 0.5 / 24)) and lin[4, 5] == 5
    quad = se.to_hourly(d, "id", "day", "v", "quadratic")
    assert quad.filter("v < 0").count() == 0


def test_pool_area_runs_blend(spark):
    h = spark.range(48).select(F.lit(1).alias("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int))").alias("ts"), F.col("id").cast("double").alias("v"))
    assert [(r.hours, r.v) for r in se.pool_days(h, "id", "ts", "v", 9).orderBy("day").collect()] == [(9, 4.0), (24, 20.5), (15, 40.0)]
    with pytest.raises(ValueError):
        se.pool_days(h, "id", "ts", "v", 24)
    c = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "id int, pos int, v double")
    assert [r.v for r in se.area_pool(c, "id", "pos", "v", 2).orderBy("bin").collect()] == pytest.approx([(0 + 1 + 2 * 0.5) / 2.5, (2 * 0.5 + 3 + 4) / 2.5])
    d = days(spark, [(1, k, 1.0) for k in (1, 2, 3, 4, 5, 8, 9, 9)])
    got = sorted((r.day.day, r.chunk) for r in se.day_runs(d, "id", "day", 2).collect())
    assert got == [(1, 0), (2, 0), (3, 1), (4, 1), (8, 0), (9, 0)]
    s = spark.createDataFrame([(1, dt.date(2024, 1, k), [x / 24] * 23 + [1 - 23 * x / 24]) for k, x in ((1, 0.5), (2, 1.2), (5, 1.0))], "id int, day date, s array<double>")
    b = {r.day.day: r.s for r in se.boundary_blend(s, "id", "day", "s", 1.0).collect()}
    assert b[1][23] == pytest.approx(b[2][0]) and b[5][0] == pytest.approx(1 / 24)
    assert all(sum(x) == pytest.approx(1, abs=1e-4) for x in b.values())
    z = se.standardise(spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "id int, v double"), "id", "v").collect()
    assert sorted(r.z for r in z) == [-1, 0, 0, 1]


def test_lookups(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    vals = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    assert {r.k: r.v for r in rel.gather(ids, vals, "k", "v", 0.001).collect()} == {1: 5.0, 2: None, 3: 0.001}
    with pytest.raises(Exception, match="no value for k 3"):
        rel.strict_gather(ids, vals, "k").collect()
    with pytest.raises(ValueError):
        rel.merge_keeping_rows([ids, vals], "k")
    steps = spark.createDataFrame([(1, 0.1), (5, 0.2)], "at int, lr double")
    probes = spark.createDataFrame([(0,), (1,), (4,), (9,)], "e int")
    assert {r.e: r.lr for r in rel.as_of(probes, steps, "e", "at", "lr").collect()} == {0: 0.1, 1: 0.1, 4: 0.1, 9: 0.2}
    a = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],)], "a array<double>").select(rel.argmax_last(F.col("a")).alias("i")).collect()
    assert a[0].i == 2
    d = rel.differences(vals, spark.createDataFrame([(2, None), (3, 1.0)], "k int, v double"), "k", "v").collect()
    assert {(r.k, r.state) for r in d} == {(1, "removed"), (3, "added")}
