"""Queries over projections (x), filters (f), joins (j), sorts and samples (l) and set operations (u) of the survey."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions import physics as ph
from talweg.functions.common import finite, station_id
from talweg.functions.ranks import interpolated, order_statistics
from talweg.operators import relational as rel
from talweg.plans import views as v
from talweg.sources.tables import table

S = SparkSession


def _share(spark: S, d: str) -> DataFrame:
    return v.reach(spark, d).withColumn("v", F.col("length_m") / 5000)


def x1_denormalize(spark: S, d: str) -> DataFrame:
    return _share(spark, d).select("comid", ph.denormalize(F.col("v"), *ph.RANGES["n"]).alias("n"), ph.denormalize(F.col("v"), *ph.RANGES["p_spatial"], True).alias("p"))


def x2_normalize(spark: S, d: str) -> DataFrame:
    return x1_denormalize(spark, d).select("comid", ph.normalize(F.col("n"), *ph.RANGES["n"]).alias("a"), ph.normalize(F.col("p"), *ph.RANGES["p_spatial"], True).alias("b"))


def _channel(spark: S, d: str) -> DataFrame:
    r = v.reach(spark, d).withColumns({k: F.lit(x) for k, x in ph.FROZEN.items()})
    return r.withColumns({"q": F.col("uparea_km2") / 10, "slope": F.greatest("slope", F.lit(ph.MINIMUMS["slope"]))})


GEOMETRY = ["depth", "top_width", "side_slope", "bottom_width", "area", "wetted_perimeter", "hydraulic_radius", "velocity"]


def x3_geometry(spark: S, d: str) -> DataFrame:
    return ph.with_geometry(_channel(spark, d)).select("comid", *GEOMETRY)


def x4_coefficients_legacy(spark: S, d: str) -> DataFrame:
    g = ph.with_celerity(ph.with_geometry(_channel(spark, d)), legacy=True)
    return ph.with_muskingum(g, positive=False, x=0.3).select("comid", "k", "c1", "c2", "c3", "c4")


def x5_celerity(spark: S, d: str) -> DataFrame:
    g = ph.with_geometry(_channel(spark, d))
    return ph.with_celerity(g).select("comid", "celerity")


def x7_coefficients(spark: S, d: str) -> DataFrame:
    return ph.with_muskingum(ph.with_celerity(ph.with_geometry(_channel(spark, d)))).select("comid", "k", "x", "c1", "c2", "c3", "c4")


def x8_leakance(spark: S, d: str) -> DataFrame:
    g = ph.with_geometry(_channel(spark, d))
    z = ph.leakance(F.col("depth"), F.col("p_spatial"), F.col("q_spatial"), F.col("length_m"), F.lit(5e-7), F.lit(0.1), F.lit(0.5))
    return g.select("comid", z.alias("zeta"))


def x9_impervious_mask(spark: S, d: str) -> DataFrame:
    return v.attributes(spark, d).select("comid", ph.impervious_mask(F.col("porosity"), 0.3).alias("mask"))


def x10_flow_scale(spark: S, d: str) -> DataFrame:
    return table(spark, d, "gages").select("row_id", ph.flow_scale(F.col("drain_sqkm"), F.col("comid_drain_sqkm"), F.col("comid_unitarea_sqkm")).alias("scale"))


def x11_unit_flow(spark: S, d: str) -> DataFrame:
    return v.gauge(spark, d).select("staid", ph.mm_per_hour_to_m3s(F.lit(1.5), F.col("drain_sqkm")).alias("q"))


def x12_reference_celerity(spark: S, d: str) -> DataFrame:
    return v.reach(spark, d).select("comid", ph.reference_celerity(F.col("uparea_km2"), F.col("slope")).alias("c"))


NAMES = ["soilgrids1km_clay", "aridity", "meanelevation", "meanp", "ndvi", "meanslope", "log10_uparea", "soilgrids1km_sand", "etpot_hargr", "porosity"]


def x13_z_scores(spark: S, d: str) -> DataFrame:
    """Attributes of the live reaches: missing ones by the full column's mean, then standardised by its mean and deviation."""
    a = v.attributes(spark, d).select("comid", *[finite(c).alias(c) for c in NAMES[:4]])
    stats = a.agg(*[F.avg(c).alias(f"_m_{c}") for c in NAMES[:4]], *[F.stddev_pop(c).alias(f"_s_{c}") for c in NAMES[:4]])
    own = v.live(spark, d).select("comid").join(a, "comid", "left").crossJoin(F.broadcast(stats))
    return own.select("comid", *[((F.coalesce(c, f"_m_{c}") - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"z_{c}") for c in NAMES[:4]])


def x15_piece_divisor(spark: S, d: str) -> DataFrame:
    from talweg.operators.network import plan_reaches, subdivide

    p = subdivide(plan_reaches(v.reach(spark, d)))
    return p.select("comid", "piece", F.count("*").over(Window.partitionBy("comid")).alias("divisor"))


def x16_scale_by_log2(spark: S, d: str) -> DataFrame:
    return v.reach(spark, d).select("comid", F.explode(F.array(*[F.lit(float(k)) for k in (-1, 0, 2)])).alias("k"), "length_m").select("comid", "k", ph.scale_by_log2(F.col("length_m"), F.col("k")).alias("v"))


def x17_log_interp(spark: S, d: str) -> DataFrame:
    a, b = F.col("length_m"), F.col("uparea_km2")
    return v.reach(spark, d).select("comid", *[ph.log_interp(a, b, t).alias(n) for n, t in (("t0", 0), ("t25", 0.25), ("t1", 1))])


def x18_arm_means(spark: S, d: str) -> DataFrame:
    a = v.reach(spark, d).select("comid", F.col("length_m").alias("a"))
    b = v.reach(spark, d).select("comid", F.col("uparea_km2").alias("b"))
    return a.join(b, "comid").select("comid", ph.mean_of_two(F.col("a"), F.col("b")).alias("linear"), ph.mean_of_two(F.col("a"), F.col("b"), True).alias("geometric"))


def x19_station_ids(spark: S, d: str) -> DataFrame:
    return table(spark, d, "split_manifest").select("entry_id", station_id("staid").alias("staid"))


def x20_learning_rates(spark: S, d: str) -> DataFrame:
    steps = spark.createDataFrame([(1, 0.005), (3, 0.001), (10, 0.0005)], "epoch_from int, lr double")
    return rel.as_of(table(spark, d, "part").select(F.col("p_size").alias("epoch")).distinct(), steps, "epoch", "epoch_from", "lr")


def _clean_days(spark: S, d: str) -> DataFrame:
    h = F.col("target_hourly_m3s")
    return table(spark, d, "pretrain_rows").filter(F.forall(h, lambda x: ~F.isnan(x) & (x >= 0) & (x < 4e5))).select("row_id", station_id("staid").alias("staid"), "day_index", h.cast("array<double>").alias("h"))


def x21_peak_hours(spark: S, d: str) -> DataFrame:
    p = rel.argmax_last(F.col("h"))
    return _clean_days(spark, d).select("row_id", p.alias("peak"), rel.circular_distance(p, F.lit(12)).alias("from_noon"))


def x22_trimmed_days(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_size").alias("rho")).distinct().select("rho", F.floor(((F.col("rho") - 1) * 24 - 24) / 24).cast("int").alias("days"))


def x23_decode(spark: S, d: str) -> DataFrame:
    """Station names from fixed-width UTF-32 bytes, as some stores keep them."""
    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode("utf-32-le").rstrip("\x00"))

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.ljust(48, "\x00").encode("utf-32-le"))

    return table(spark, d, "gages").select("row_id", decode(encode("staname")).alias("staname"))


def x24_power_law_n(spark: S, d: str) -> DataFrame:
    a = v.attributes(spark, d).select("comid", finite("log10_uparea").alias("x")).filter("x > -100")
    e = order_statistics(a, [], "x", {"lo": interpolated(0.01), "hi": interpolated(0.99)}).select(F.array("lo", "hi").alias("e"))
    y = F.log10(F.lit(0.15)) + (F.col("x") - F.col("e")[0]) * (F.log10(F.lit(0.015)) - F.log10(F.lit(0.15))) / (F.col("e")[1] - F.col("e")[0])
    return a.crossJoin(F.broadcast(e)).select("comid", F.greatest(F.lit(0.015), F.least(F.lit(0.15), F.pow(F.lit(10.0), y))).alias("n"))


def x26_group_tags(spark: S, d: str) -> DataFrame:
    return table(spark, d, "gages").select("row_id", F.regexp_replace("staname", "[^A-Za-z0-9._-]", "").alias("tag"))


def x27_checkpoint_names(spark: S, d: str) -> DataFrame:
    name = F.concat(F.lit("epoch_"), F.pmod("row_id", F.lit(7)).cast("string"), F.lit("_mb_"), F.pmod("row_id", F.lit(50)).cast("string"))
    n = table(spark, d, "gages").select("row_id", name.alias("s"))
    pick = lambda g: F.regexp_extract("s", r"^epoch_(\d+)_mb_(\d+)$", g).cast("int")
    return n.select("row_id", pick(1).alias("epoch"), pick(2).alias("mb"))


def _valid(spark: S, d: str) -> DataFrame:
    return table(spark, d, "gages").filter(F.coalesce("da_valid", F.lit(True)))


def f1_area_valid(spark: S, d: str) -> DataFrame:
    return _valid(spark, d).select("row_id")


def f2_with_subgraph(spark: S, d: str) -> DataFrame:
    from talweg.plans.network_q import g12_gauge_edges

    return v.gauge(spark, d).join(g12_gauge_edges(spark, d), "staid", "left_semi").select("staid")


def f3_with_observations(spark: S, d: str) -> DataFrame:
    return v.gauge(spark, d).join(v.obs(spark, d), "staid", "left_semi").select("staid")


def f4_valid_gauges(spark: S, d: str) -> DataFrame:
    return f2_with_subgraph(spark, d).join(v.obs(spark, d), "staid", "left_semi")


def f5_headwaters(spark: S, d: str) -> DataFrame:
    r = v.reach(spark, d)
    return r.join(r.select(F.col("parent").alias("comid")), "comid", "left_anti").select("comid")


def f6_complete_stations(spark: S, d: str) -> DataFrame:
    return rel.whole_groups(table(spark, d, "pretrain_rows").select(station_id("staid").alias("staid"), "daily_q_m3s"), "staid", "daily_q_m3s")


def f7_finite_pairs(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d)


def f8_complete_days(spark: S, d: str) -> DataFrame:
    """Days with 24 readings of an hourly series, and their mean."""
    h = v.hourly(spark, d).groupBy("id", F.col("ts").cast("date").alias("day")).agg(F.count("value").alias("n"), F.avg("value").alias("daily"))
    return h.filter("n = 24").select("id", "day", "daily")


def f8_complete_station_days(spark: S, d: str) -> DataFrame:
    return _clean_days(spark, d).select("row_id", (F.aggregate("h", F.lit(0.0), lambda a, x: a + x) / F.size("h")).alias("daily"))


def f9_flow_floor(spark: S, d: str) -> DataFrame:
    return f8_complete_station_days(spark, d).filter("daily > 1e-3").select("row_id")


def f10_corrupted_chunks(spark: S, d: str) -> DataFrame:
    """Stations with a non-finite reading, or nothing but zeros."""
    x = F.col("x").cast("double")
    e = table(spark, d, "pretrain_rows").select(station_id("staid").alias("staid"), F.explode("target_hourly_m3s").alias("x"))
    g = e.groupBy("staid").agg(F.bool_or(F.isnan(x) | (F.abs(x) == float("inf"))).alias("broken"), F.every(x == 0).alias("zeros"))
    return g.filter("broken or zeros").select("staid", F.when(F.col("broken"), "non-finite").otherwise("all zero").alias("reason"))


def f11_area_and_coverage(spark: S, d: str) -> DataFrame:
    """Gauges whose areas agree within 20 % and whose record covers enough of two periods."""
    g = table(spark, d, "gages").filter(F.abs(F.col("drain_sqkm") - F.col("comid_drain_sqkm")) / F.col("drain_sqkm") <= 0.2).select(station_id("staid").alias("staid")).distinct()
    o = v.pairs(spark, d).withColumn("late", F.col("day") >= F.lit("2000-01-01").cast("date"))
    c = o.groupBy("staid").agg(F.count_if(~F.col("late")).alias("early_days"), F.count_if(F.col("late")).alias("late_days")).filter("early_days >= 10 and late_days >= 10")
    return g.join(c, "staid")


def f12_losing_stations(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).groupBy("staid").agg((F.avg("pred") / F.avg("obs")).alias("ratio")).filter("ratio > 1")


def f13_layout(spark: S, d: str) -> DataFrame:
    """Columns that the reach table lacks; none if its layout is sound."""
    want = ["comid", "lengthkm", "slope", "nextdownid", "up1", "up2", "up3", "up4"]
    have = table(spark, d, "flowlines").columns
    return spark.createDataFrame([(c, c in have) for c in want], "column string, there boolean")


def j1_hits_and_misses(spark: S, d: str) -> DataFrame:
    return rel.hits_and_misses(table(spark, d, "gages").filter("comid is not null").select("comid").distinct(), v.live(spark, d), "comid")


def j2_last_row_wins(spark: S, d: str) -> DataFrame:
    return rel.last_wins(table(spark, d, "gages").filter("comid > 0"), "comid", "row_id")


def j3_inflow_or_default(spark: S, d: str) -> DataFrame:
    day = v.qr(spark, d).filter("day = date'1995-06-15'").select("comid", "qr")
    return rel.gather(v.reach(spark, d).select("comid"), day, "comid", "qr", 0.001)


def j4_strict_lookup(spark: S, d: str) -> DataFrame:
    r = v.reach(spark, d).select("comid", "slope")
    return rel.strict_gather(v.gauge(spark, d).select("staid", "comid"), r, "comid").select("staid", "slope")


def j5_align(spark: S, d: str) -> DataFrame:
    return v.live(spark, d).select("comid").join(v.attributes(spark, d).select("comid", finite("aridity").alias("aridity")), "comid", "left")


def j6_sorted_join(spark: S, d: str) -> DataFrame:
    return v.live(spark, d).select("comid", "fid").join(v.attributes(spark, d).select("comid", "zone_id").hint("merge"), "comid")


def j7_gather_by_position(spark: S, d: str) -> DataFrame:
    """Geometry of a gauge's active reaches, by the dense position in its own list."""
    from talweg.plans.network_q import g16_compressed

    return g16_compressed(spark, d).join(v.reach(spark, d).select("comid", "length_m", "slope"), "comid").select("staid", "pos", "length_m", "slope")


def j10_recorded_stations(spark: S, d: str) -> DataFrame:
    """The stations of a manifest that still exist."""
    m = table(spark, d, "split_manifest").select(station_id("staid").alias("staid")).distinct()
    return m.join(table(spark, d, "gages").select(station_id("staid").alias("staid")), "staid", "left_semi")


def j8_expand_to_pieces(spark: S, d: str) -> DataFrame:
    from talweg.operators.network import plan_reaches, subdivide

    r = v.reach(spark, d)
    return subdivide(plan_reaches(r)).select("comid", "piece").join(r.select("comid", "slope"), "comid")


def j9_parent_of_row(spark: S, d: str) -> DataFrame:
    """The reach that owns a row of the subdivided network: the last offset at or before it."""
    from talweg.operators.network import plan_reaches

    p = plan_reaches(v.reach(spark, d)).select(F.floor(F.col("comid") / 1000).alias("block"), "comid", "pieces")
    off = p.withColumn("pos", F.coalesce(F.sum("pieces").over(Window.partitionBy("block").orderBy("comid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = off.select("block", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("pieces") - 1)).alias("pos"))
    return rel.as_of_sorted(rows, off.select("block", "pos", F.col("comid").alias("owner")), ["block"], "pos", "owner").select("block", "pos", "owner")


def j11_sum_of_upstream(spark: S, d: str) -> DataFrame:
    """One sparse product: each reach gets the sum of its direct upstream neighbours."""
    r = v.reach(spark, d)
    return r.filter("parent is not null").groupBy(F.col("parent").alias("comid")).agg(F.sum("length_m").alias("inflow"))


def j12_paired_delta(spark: S, d: str) -> DataFrame:
    p = v.pairs(spark, d)
    a = p.filter("year(day) % 2 = 0").groupBy("staid").agg(F.avg("pred").alias("even"))
    b = p.filter("year(day) % 2 = 1").groupBy("staid").agg(F.avg("pred").alias("odd"))
    return a.join(b, "staid", "full").select("staid", (F.col("even") - F.col("odd")).alias("delta"))


def j13_three_way_merge(spark: S, d: str) -> DataFrame:
    r = v.reach(spark, d)
    return rel.merge_keeping_rows([r.select("comid", "length_m"), r.select("comid", "slope"), r.select("comid", "uparea_km2")], "comid")


def j14_class_or_unknown(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "reconciliation").select(station_id("staid").alias("staid"), F.when(F.col("is_kept"), "kept").otherwise("dropped").alias("kind"))
    s = table(spark, d, "gages").select(station_id("staid").alias("staid")).distinct()
    return s.join(c, "staid", "left").select("staid", F.coalesce("kind", F.lit("unknown")).alias("kind"))


def j15_window_days(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).filter(F.col("day").between("1995-10-01", "2010-09-30")).groupBy("staid").agg(F.count("*").alias("n"))


def l1_sorted_edges(spark: S, d: str) -> DataFrame:
    r = v.reach(spark, d).filter("parent is not null").select(F.col("parent").alias("down"), F.col("comid").alias("up"))
    return r.orderBy("down", "up")


def l3_latest_checkpoint(spark: S, d: str) -> DataFrame:
    return x27_checkpoint_names(spark, d).agg(F.max_by("row_id", F.struct("epoch", "mb", "row_id")).alias("row_id"))


def l4_newest_runs(spark: S, d: str) -> DataFrame:
    return rel.newest(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, ["o_custkey"]).select("o_custkey", "o_orderkey")


def l5_shuffled_batches(spark: S, d: str) -> DataFrame:
    """Seeded shuffle of the gauges of each nation into batches of 4, the short last one dropped."""
    s = table(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey")
    i = F.row_number().over(w.orderBy(F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit("42"))))) - 1
    b = s.select("s_suppkey", "s_nationkey", F.floor(i / 4).alias("batch"))
    return b.withColumn("_n", F.count("*").over(Window.partitionBy("s_nationkey", "batch"))).filter("_n = 4").drop("_n")


def l6_sequential_batches(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    i = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return s.select("s_suppkey", "s_nationkey", F.floor(i / 4).alias("batch"))


def l7_replayed_batches(spark: S, d: str) -> DataFrame:
    plan = table(spark, d, "split_manifest").select("seed", F.pmod("entry_id", F.lit(10)).alias("mb"), station_id("staid").alias("staid")).distinct()
    g = table(spark, d, "gages").groupBy(station_id("staid").alias("staid")).agg(F.max("drain_sqkm").alias("area"))
    return plan.join(g, "staid").groupBy("seed", "mb").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def l8_stratified_split(spark: S, d: str) -> DataFrame:
    g = table(spark, d, "gages").groupBy(station_id("staid").alias("staid")).agg(F.max("drain_sqkm").alias("drain_sqkm"))
    return rel.stratified_split(g, "staid", "drain_sqkm")


def l9_area_balanced(spark: S, d: str) -> DataFrame:
    """All large gauges, then a seeded choice of middling and small ones."""
    g = table(spark, d, "gages").groupBy(station_id("staid").alias("staid")).agg(F.max("drain_sqkm").alias("a"))
    kind = F.when(F.col("a") >= 5000, "big").when(F.col("a") >= 1000, "mid").otherwise("small")
    g = g.withColumn("kind", kind).withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(F.md5("staid"), "staid")))
    return g.filter("kind = 'big' or kind = 'mid' and rn <= 40 or kind = 'small' and rn <= 100").select("staid", "kind")


def l10_probe_sample(spark: S, d: str) -> DataFrame:
    """At most two reaches of each gauge, then at most 5 of each stratum of slope."""
    from talweg.plans.network_q import _gauge_reach

    r = _gauge_reach(spark, d).join(v.reach(spark, d).select("comid", "slope"), "comid").withColumn("stratum", F.floor(F.col("slope") * 300))
    two = rel.newest(r, [F.md5(F.concat_ws("|", "staid", F.col("comid").cast("string"))), F.col("comid")], 2, ["staid"])
    return rel.newest(two, [F.md5(F.concat_ws("|", F.col("comid").cast("string"), "staid"))], 5, ["stratum"]).select("staid", "comid", "stratum")


def l11_terciles(spark: S, d: str) -> DataFrame:
    a = v.attributes(spark, d).select("comid", finite("log10_uparea").alias("x")).filter("x > -100")
    e = order_statistics(a, [], "x", {"lo": interpolated(0.33), "hi": interpolated(0.67)}).select(F.array("lo", "hi").alias("e"))
    return a.crossJoin(F.broadcast(e)).select("comid", F.when(F.col("x") <= F.col("e")[0], 0).when(F.col("x") <= F.col("e")[1], 1).otherwise(2).alias("tercile"))


def l12_sample_read(spark: S, d: str) -> DataFrame:
    """The first five stations and three days of each: the look an import takes."""
    ids = v.pairs(spark, d).select("staid").distinct().orderBy("staid").limit(5)
    return rel.newest(v.pairs(spark, d).join(F.broadcast(ids), "staid"), [F.col("day")], 3, ["staid"])


def l13_coverage(spark: S, d: str) -> DataFrame:
    n = v.live(spark, d).select("comid").join(v.attributes(spark, d).select("comid", F.lit(1).alias("_t")), "comid", "left")
    return n.agg(F.count("*").alias("n"), F.count("_t").alias("present"), (F.count("_t") / F.count("*")).alias("share"))


def u1_union_of_edges(spark: S, d: str) -> DataFrame:
    live = v.live(spark, d)
    a = live.filter("nextdownid > 0").select(F.col("nextdownid").alias("down"), F.col("comid").alias("up"))
    b = live.filter("up1 > 0").select(F.col("comid").alias("down"), F.col("up1").alias("up"))
    return a.union(b).distinct()


def u2_ids_needed(spark: S, d: str) -> DataFrame:
    from talweg.plans.network_q import _gauge_reach

    return _gauge_reach(spark, d).select("comid").distinct()


def u3_endpoints(spark: S, d: str) -> DataFrame:
    r = v.reach(spark, d).filter("parent is not null")
    return r.select("comid").union(r.select("parent")).distinct()


def u4_matched_population(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pretrain_rows").select(station_id("staid").alias("staid")).intersect(table(spark, d, "daily_obs").select(station_id("gage_id").alias("staid")))


def u5_without_subgraph(spark: S, d: str) -> DataFrame:
    return table(spark, d, "gages").select(station_id("staid").alias("staid")).subtract(table(spark, d, "gage_subgraphs").select(station_id("staid").alias("staid")))


def u6_concat_keep_first(spark: S, d: str) -> DataFrame:
    """Two lists one behind the other, of each station the first row."""
    a = table(spark, d, "gages").select(station_id("staid").alias("staid"), F.lit(0).alias("f"), "row_id")
    b = table(spark, d, "gage_subgraphs").select(station_id("staid").alias("staid"), F.lit(1).alias("f"), F.col("sub_id").alias("row_id"))
    return rel.newest(a.unionByName(b), [F.col("f"), F.col("row_id")], 1, ["staid"]).select("staid", "f", "row_id")


def u7_concat_strata(spark: S, d: str) -> DataFrame:
    g = table(spark, d, "gages")
    return g.filter("drain_sqkm >= 5000").select("row_id").unionByName(g.filter("drain_sqkm < 100").select("row_id"))


def u8_changed_keys(spark: S, d: str) -> DataFrame:
    """Reaches whose downstream link changed between their first and their current version."""
    f = table(spark, d, "flowlines")
    first = f.groupBy("comid").agg(F.min_by("nextdownid", F.struct("loaded_at", "fid")).alias("nextdownid"))
    text = F.col("nextdownid").cast("string").alias("nextdownid")
    return rel.differences(first.select("comid", text), v.live(spark, d).select("comid", text), "comid", "nextdownid")


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "xfjlu" and k[1].isdigit()}

_CH = v.sql("reach") + """, ch AS (SELECT comid, length_m, uparea_km2 / 10 AS q, greatest(slope, CAST(1e-3 AS DOUBLE)) AS slope, CAST(0.05 AS DOUBLE) AS n, CAST(21 AS DOUBLE) AS p, CAST(0.5 AS DOUBLE) + CAST(1e-6 AS DOUBLE) AS e FROM reach),
g1 AS (SELECT *, greatest(pow(q * n * (e + 1) / (p * sqrt(slope) + CAST(1e-8 AS DOUBLE)), 3 / (e * 3 + 5)), CAST(0.01 AS DOUBLE)) AS depth FROM ch),
g2 AS (SELECT *, p * pow(depth, e) AS top_width FROM g1),
g3 AS (SELECT *, greatest(CAST(0.5 AS DOUBLE), least(CAST(50 AS DOUBLE), top_width * e / (depth * 2))) AS side_slope FROM g2),
g4 AS (SELECT *, greatest(top_width - side_slope * depth * 2, CAST(0.01 AS DOUBLE)) AS bottom_width FROM g3),
g5 AS (SELECT *, (top_width + bottom_width) * depth / 2 AS area, bottom_width + depth * sqrt(side_slope * side_slope + 1) * 2 AS wetted_perimeter FROM g4),
g6 AS (SELECT *, area / wetted_perimeter AS hydraulic_radius FROM g5),
geo AS (SELECT *, pow(hydraulic_radius, CAST(2 AS DOUBLE) / 3) * sqrt(slope) / n AS velocity FROM g6),
vel AS (SELECT *, greatest(CAST(0.01 AS DOUBLE), least(CAST(15 AS DOUBLE), velocity)) AS vc FROM geo),
cel AS (SELECT *, vc * (CAST(5 AS DOUBLE) / 3 - area * sqrt(side_slope * side_slope + 1) / (top_width * wetted_perimeter) * (CAST(4 AS DOUBLE) / 3)) AS celerity FROM vel),
mk AS (SELECT *, greatest(length_m / celerity, CAST(1818 AS DOUBLE)) AS k FROM cel),
mx AS (SELECT *, least(greatest(CAST(0 AS DOUBLE), least(CAST(0.5 AS DOUBLE), (1 - q / (top_width * slope * celerity * length_m + CAST(1e-12 AS DOUBLE))) * 0.5)), 3600 / k * CAST(0.495 AS DOUBLE), (1 - 3600 / k * 0.5) * CAST(0.99 AS DOUBLE)) AS x FROM mk),
mc AS (SELECT *, 2 * k * x AS kx, 2 * k * (1 - x) AS rest FROM mx),
coef AS (SELECT *, (3600 - kx) / (rest + 3600) AS c1, (kx + 3600) / (rest + 3600) AS c2, (rest - 3600) / (rest + 3600) AS c3, 7200 / (rest + 3600) AS c4 FROM mc)"""
_LOG = "(ln(CAST(200 AS DOUBLE)) - ln(CAST(1 AS DOUBLE) + CAST(1e-6 AS DOUBLE)))"
_PRE = f"SELECT {v._pad('staid')} AS staid, * EXCLUDE (staid) FROM pretrain_rows"
_CLEAN = "len(list_filter(target_hourly_m3s, lambda y: isnan(y) OR NOT (y >= 0 AND y < 4e5))) = 0"
_ATTR = f"WITH {v.SQL['attributes']}"
from talweg.plans.network_q import _GAUGE, _PLAN  # noqa: E402

SQL = {
    "x1_denormalize": v.sql("reach") + f" SELECT comid, length_m / 5000 * (CAST(0.25 AS DOUBLE) - CAST(0.015 AS DOUBLE)) + CAST(0.015 AS DOUBLE) AS n, exp(length_m / 5000 * {_LOG} + ln(CAST(1 AS DOUBLE) + CAST(1e-6 AS DOUBLE))) AS p FROM reach",
    "x2_normalize": v.sql("reach") + " SELECT comid, length_m / 5000 AS a, length_m / 5000 AS b FROM reach",
    "x3_geometry": _CH + " SELECT comid, depth, top_width, side_slope, bottom_width, area, wetted_perimeter, hydraulic_radius, velocity FROM geo",
    "x4_coefficients_legacy": _CH + ", k4 AS (SELECT comid, length_m / (vc * (CAST(5 AS DOUBLE) / 3)) AS k FROM vel), d4 AS (SELECT *, 2 * k * CAST(0.3 AS DOUBLE) AS kx, 2 * k * CAST(0.7 AS DOUBLE) AS r FROM k4) SELECT comid, k, (3600 - kx) / (r + 3600) AS c1, (kx + 3600) / (r + 3600) AS c2, (r - 3600) / (r + 3600) AS c3, 7200 / (r + 3600) AS c4 FROM d4",
    "x5_celerity": _CH + " SELECT comid, celerity FROM cel",
    "x7_coefficients": _CH + " SELECT comid, k, x, c1, c2, c3, c4 FROM coef",
    "x8_leakance": _CH + " SELECT comid, CAST(0.5 AS DOUBLE) * pow(p * depth, e) * length_m * CAST(5e-7 AS DOUBLE) * greatest(depth - CAST(0.1 AS DOUBLE), 0) AS zeta FROM geo",
    "x9_impervious_mask": _ATTR + " SELECT comid, CASE WHEN NOT isnan(porosity) AND porosity > CAST(0.3 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS mask FROM attributes",
    "x10_flow_scale": "SELECT row_id, CASE WHEN comid_unitarea_sqkm > 0 AND drain_sqkm < comid_drain_sqkm AND comid_drain_sqkm - drain_sqkm < comid_unitarea_sqkm THEN (comid_unitarea_sqkm - (comid_drain_sqkm - drain_sqkm)) / comid_unitarea_sqkm ELSE CAST(1 AS DOUBLE) END AS scale FROM gages",
    "x11_unit_flow": v.sql("gauge") + " SELECT staid, CAST(1.5 AS DOUBLE) * drain_sqkm / CAST(3.6 AS DOUBLE) AS q FROM gauge",
    "x12_reference_celerity": _PLAN + " SELECT comid, target / 3600 AS c FROM plan",
    "x13_z_scores": f"WITH {v.SQL['live']}, {v.SQL['attributes']}, a AS (SELECT comid, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in NAMES[:4]) + " FROM attributes), s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NAMES[:4]) + " FROM a) SELECT live.comid, " + ", ".join(f"(coalesce(a.{c}, m_{c}) - m_{c}) / s_{c} AS z_{c}" for c in NAMES[:4]) + " FROM live LEFT JOIN a USING (comid) CROSS JOIN s",
    "x15_piece_divisor": _PLAN + " SELECT comid, unnest(range(0, pieces)) AS piece, pieces AS divisor FROM plan",
    "x16_scale_by_log2": v.sql("reach") + " SELECT comid, k, length_m * pow(CAST(2 AS DOUBLE), k) AS v FROM reach CROSS JOIN (VALUES (CAST(-1 AS DOUBLE)), (0), (2)) t(k)",
    "x17_log_interp": v.sql("reach") + " SELECT comid, length_m AS t0, exp(CAST(0.75 AS DOUBLE) * ln(length_m) + CAST(0.25 AS DOUBLE) * ln(uparea_km2)) AS t25, uparea_km2 AS t1 FROM reach",
    "x18_arm_means": v.sql("reach") + " SELECT comid, (length_m + uparea_km2) / 2 AS linear, exp((ln(length_m) + ln(uparea_km2)) / 2) AS geometric FROM reach",
    "x19_station_ids": f"SELECT entry_id, {v._pad('staid')} AS staid FROM split_manifest",
    "x20_learning_rates": "SELECT DISTINCT p_size AS epoch, CASE WHEN p_size >= 10 THEN CAST(0.0005 AS DOUBLE) WHEN p_size >= 3 THEN CAST(0.001 AS DOUBLE) ELSE CAST(0.005 AS DOUBLE) END AS lr FROM part",
    "x21_peak_hours": f"WITH p AS (SELECT row_id, len(target_hourly_m3s) - list_position(list_reverse(target_hourly_m3s), list_max(target_hourly_m3s)) AS peak FROM pretrain_rows WHERE {_CLEAN}) SELECT row_id, peak, least(abs(peak - 12), 24 - abs(peak - 12)) AS from_noon FROM p",
    "x22_trimmed_days": "SELECT DISTINCT p_size AS rho, CAST(floor(((p_size - 1) * 24 - 24) / CAST(24 AS DOUBLE)) AS INTEGER) AS days FROM part",
    "x23_decode": "SELECT row_id, staname FROM gages",
    "x24_power_law_n": _ATTR + ", a AS (SELECT comid, log10_uparea AS x FROM attributes WHERE isfinite(log10_uparea) AND log10_uparea > -100), e AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM a) SELECT comid, greatest(CAST(0.015 AS DOUBLE), least(CAST(0.15 AS DOUBLE), pow(CAST(10 AS DOUBLE), log10(CAST(0.15 AS DOUBLE)) + (x - lo) * (log10(CAST(0.015 AS DOUBLE)) - log10(CAST(0.15 AS DOUBLE))) / (hi - lo)))) AS n FROM a CROSS JOIN e",
    "x26_group_tags": "SELECT row_id, regexp_replace(staname, '[^A-Za-z0-9._-]', '', 'g') AS tag FROM gages",
    "x27_checkpoint_names": "SELECT row_id, CAST(row_id % 7 AS INTEGER) AS epoch, CAST(row_id % 50 AS INTEGER) AS mb FROM gages",
    "f1_area_valid": "SELECT row_id FROM gages WHERE coalesce(da_valid, true)",
    "f2_with_subgraph": _GAUGE + " SELECT DISTINCT staid FROM ge",
    "f3_with_observations": v.sql("gauge", "obs") + " SELECT staid FROM gauge WHERE staid IN (SELECT staid FROM obs)",
    "f4_valid_gauges": _GAUGE + f", {v.SQL['obs']} SELECT DISTINCT staid FROM ge WHERE staid IN (SELECT staid FROM obs)",
    "f5_headwaters": v.sql("reach") + " SELECT comid FROM reach WHERE comid NOT IN (SELECT parent FROM reach WHERE parent IS NOT NULL)",
    "f6_complete_stations": f"SELECT staid FROM ({_PRE}) GROUP BY staid HAVING count(*) = count(daily_q_m3s)",
    "f7_finite_pairs": v.sql("pairs") + " SELECT staid, day, pred, obs FROM pairs",
    "f8_complete_days": v.sql("hourly") + " SELECT id, CAST(ts AS DATE) AS day, avg(value) AS daily FROM hourly GROUP BY ALL HAVING count(value) = 24",
    "f8_complete_station_days": f"SELECT row_id, list_sum(CAST(target_hourly_m3s AS DOUBLE[])) / 24 AS daily FROM pretrain_rows WHERE {_CLEAN}",
    "f9_flow_floor": f"SELECT row_id FROM pretrain_rows WHERE {_CLEAN} AND list_sum(CAST(target_hourly_m3s AS DOUBLE[])) / 24 > 1e-3",
    "f10_corrupted_chunks": f"WITH e AS (SELECT staid, unnest(target_hourly_m3s) AS x FROM ({_PRE})), g AS (SELECT staid, bool_or(NOT isfinite(x)) AS broken, bool_and(x = 0) AS zeros FROM e GROUP BY staid) SELECT staid, CASE WHEN broken THEN 'non-finite' ELSE 'all zero' END AS reason FROM g WHERE broken OR zeros",
    "f11_area_and_coverage": v.sql("pairs") + f", g AS (SELECT DISTINCT {v._pad('staid')} AS staid FROM gages WHERE abs(drain_sqkm - comid_drain_sqkm) / drain_sqkm <= CAST(0.2 AS DOUBLE)), c AS (SELECT staid, count_if(day < DATE '2000-01-01') AS early_days, count_if(day >= DATE '2000-01-01') AS late_days FROM pairs GROUP BY staid) SELECT staid, early_days, late_days FROM c JOIN g USING (staid) WHERE early_days >= 10 AND late_days >= 10",
    "f12_losing_stations": v.sql("pairs") + " SELECT staid, avg(pred) / avg(obs) AS ratio FROM pairs GROUP BY staid HAVING avg(pred) / avg(obs) > 1",
    "f13_layout": "SELECT c AS \"column\", c IN (SELECT column_name FROM information_schema.columns WHERE table_name = 'flowlines') AS there FROM (VALUES ('comid'), ('lengthkm'), ('slope'), ('nextdownid'), ('up1'), ('up2'), ('up3'), ('up4')) t(c)",
    "j1_hits_and_misses": f"WITH {v.SQL['live']} SELECT DISTINCT comid, comid IN (SELECT comid FROM live) AS found FROM gages WHERE comid IS NOT NULL",
    "j2_last_row_wins": "SELECT comid, max(row_id) AS row_id FROM gages WHERE comid > 0 GROUP BY comid",
    "j3_inflow_or_default": v.sql("reach", "qr") + " SELECT r.comid, CASE WHEN q.comid IS NULL THEN CAST(0.001 AS DOUBLE) ELSE q.qr END AS qr FROM reach r LEFT JOIN (SELECT * FROM qr WHERE day = DATE '1995-06-15') q USING (comid)",
    "j4_strict_lookup": v.sql("reach", "gauge") + " SELECT staid, slope FROM gauge JOIN reach USING (comid)",
    "j5_align": f"WITH {v.SQL['live']}, {v.SQL['attributes']} SELECT comid, CASE WHEN isfinite(aridity) THEN aridity END AS aridity FROM live LEFT JOIN attributes USING (comid)",
    "j6_sorted_join": f"WITH {v.SQL['live']}, {v.SQL['attributes']} SELECT comid, fid, zone_id FROM live JOIN attributes USING (comid)",
    "j7_gather_by_position": _GAUGE + ", h AS (SELECT anc AS comid, max(hops) AS height FROM closure GROUP BY anc), m AS (SELECT staid, down AS comid FROM ge UNION SELECT staid, up FROM ge) SELECT staid, row_number() OVER (PARTITION BY staid ORDER BY height, comid) - 1 AS pos, length_m, slope FROM m JOIN h USING (comid) JOIN reach USING (comid)",
    "j10_recorded_stations": f"SELECT DISTINCT {v._pad('staid')} AS staid FROM split_manifest WHERE {v._pad('staid')} IN (SELECT {v._pad('staid')} FROM gages)",
    "j8_expand_to_pieces": _PLAN + " SELECT comid, unnest(range(0, pieces)) AS piece, slope FROM plan",
    "j9_parent_of_row": _PLAN + ", o AS (SELECT CAST(floor(comid / CAST(1000 AS DOUBLE)) AS BIGINT) AS block, comid, pieces, coalesce(sum(pieces) OVER (PARTITION BY CAST(floor(comid / CAST(1000 AS DOUBLE)) AS BIGINT) ORDER BY comid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM plan) SELECT block, CAST(off + unnest(range(0, pieces)) AS BIGINT) AS pos, comid AS owner FROM o",
    "j11_sum_of_upstream": v.sql("reach") + " SELECT parent AS comid, sum(length_m) AS inflow FROM reach WHERE parent IS NOT NULL GROUP BY parent",
    "j12_paired_delta": v.sql("pairs") + " SELECT staid, avg(pred) FILTER (year(day) % 2 = 0) - avg(pred) FILTER (year(day) % 2 = 1) AS delta FROM pairs GROUP BY staid",
    "j13_three_way_merge": v.sql("reach") + " SELECT comid, length_m, slope, uparea_km2 FROM reach",
    "j14_class_or_unknown": f"SELECT s.staid, CASE WHEN is_kept IS NULL THEN 'unknown' WHEN is_kept THEN 'kept' ELSE 'dropped' END AS kind FROM (SELECT DISTINCT {v._pad('staid')} AS staid FROM gages) s LEFT JOIN (SELECT {v._pad('staid')} AS staid, is_kept FROM reconciliation) r USING (staid)",
    "j15_window_days": v.sql("pairs") + " SELECT staid, count(*) AS n FROM pairs WHERE day BETWEEN DATE '1995-10-01' AND DATE '2010-09-30' GROUP BY staid",
    "l1_sorted_edges": v.sql("reach") + " SELECT parent AS down, comid AS up FROM reach WHERE parent IS NOT NULL",
    "l3_latest_checkpoint": "SELECT arg_max(row_id, (row_id % 7, row_id % 50, row_id)) AS row_id FROM gages",
    "l4_newest_runs": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3",
    "l5_shuffled_batches": "WITH b AS (SELECT s_suppkey, s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(CAST(s_suppkey AS VARCHAR) || '42')) - 1) // 4 AS batch FROM supplier) SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY s_nationkey, batch) = 4",
    "l6_sequential_batches": "SELECT s_suppkey, s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 4 AS batch FROM supplier",
    "l7_replayed_batches": f"WITH p AS (SELECT DISTINCT seed, entry_id % 10 AS mb, {v._pad('staid')} AS staid FROM split_manifest), g AS (SELECT {v._pad('staid')} AS staid, max(drain_sqkm) AS area FROM gages GROUP BY 1) SELECT seed, mb, count(*) AS n, sum(area) AS area FROM p JOIN g USING (staid) GROUP BY seed, mb",
    "l8_stratified_split": f"WITH g AS (SELECT {v._pad('staid')} AS staid, max(drain_sqkm) AS a FROM gages GROUP BY 1), t AS (SELECT staid, CAST((row_number() OVER (ORDER BY a, staid) - 1) // CAST(ceil((SELECT count(*) FROM g) / CAST(3 AS DOUBLE)) AS BIGINT) AS INTEGER) AS tercile FROM g), i AS (SELECT staid, tercile, row_number() OVER (PARTITION BY tercile ORDER BY sha256(staid || '|42'), staid) AS i, count(*) OVER (PARTITION BY tercile) AS m FROM t) SELECT staid, tercile, CASE WHEN i <= round(m * CAST(0.1 AS DOUBLE)) THEN 'val' WHEN i <= round(m * CAST(0.1 AS DOUBLE)) + round(m * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM i",
    "l9_area_balanced": f"WITH g AS (SELECT {v._pad('staid')} AS staid, max(drain_sqkm) AS a FROM gages GROUP BY 1), k AS (SELECT staid, CASE WHEN a >= 5000 THEN 'big' WHEN a >= 1000 THEN 'mid' ELSE 'small' END AS kind FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(staid), staid) AS rn FROM k) SELECT staid, kind FROM r WHERE kind = 'big' OR kind = 'mid' AND rn <= 40 OR kind = 'small' AND rn <= 100",
    "l10_probe_sample": _GAUGE + ", r AS (SELECT staid, comid, CAST(floor(slope * 300) AS BIGINT) AS stratum FROM gr JOIN reach USING (comid)), two AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY staid ORDER BY md5(staid || '|' || comid), comid) <= 2) SELECT staid, comid, stratum FROM two QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(comid || '|' || staid)) <= 5",
    "l11_terciles": _ATTR + ", a AS (SELECT comid, log10_uparea AS x FROM attributes WHERE isfinite(log10_uparea) AND log10_uparea > -100), e AS (SELECT quantile_cont(x, 0.33) AS lo, quantile_cont(x, 0.67) AS hi FROM a) SELECT comid, CASE WHEN x <= lo THEN 0 WHEN x <= hi THEN 1 ELSE 2 END AS tercile FROM a CROSS JOIN e",
    "l12_sample_read": v.sql("pairs") + " SELECT staid, day, pred, obs FROM pairs WHERE staid IN (SELECT DISTINCT staid FROM pairs ORDER BY staid LIMIT 5) QUALIFY row_number() OVER (PARTITION BY staid ORDER BY day) <= 3",
    "l13_coverage": f"WITH {v.SQL['live']}, {v.SQL['attributes']} SELECT count(*) AS n, count(a.comid) AS present, count(a.comid) / CAST(count(*) AS DOUBLE) AS share FROM live LEFT JOIN attributes a USING (comid)",
    "u1_union_of_edges": f"WITH {v.SQL['live']} SELECT nextdownid AS down, comid AS up FROM live WHERE nextdownid > 0 UNION SELECT comid, up1 FROM live WHERE up1 > 0",
    "u2_ids_needed": _GAUGE + " SELECT DISTINCT comid FROM gr",
    "u3_endpoints": v.sql("reach") + " SELECT comid FROM reach WHERE parent IS NOT NULL UNION SELECT parent FROM reach WHERE parent IS NOT NULL",
    "u4_matched_population": f"SELECT {v._pad('staid')} AS staid FROM pretrain_rows INTERSECT SELECT {v._pad('gage_id')} FROM daily_obs",
    "u5_without_subgraph": f"SELECT {v._pad('staid')} AS staid FROM gages EXCEPT SELECT {v._pad('staid')} FROM gage_subgraphs",
    "u6_concat_keep_first": f"WITH a AS (SELECT {v._pad('staid')} AS staid, 0 AS f, row_id FROM gages UNION ALL SELECT {v._pad('staid')}, 1, sub_id FROM gage_subgraphs) SELECT staid, f, row_id FROM a QUALIFY row_number() OVER (PARTITION BY staid ORDER BY f, row_id) = 1",
    "u7_concat_strata": "SELECT row_id FROM gages WHERE drain_sqkm >= 5000 UNION ALL SELECT row_id FROM gages WHERE drain_sqkm < 100",
    "u8_changed_keys": f"""WITH {v.SQL['live']}, a AS (SELECT comid, nextdownid AS l FROM flowlines QUALIFY row_number() OVER (PARTITION BY comid ORDER BY loaded_at, fid) = 1)
SELECT comid, CAST(l AS VARCHAR) AS "left", CAST(b.nextdownid AS VARCHAR) AS "right", CASE WHEN a.comid IS NULL THEN 'added' WHEN b.comid IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN live b USING (comid) WHERE a.comid IS NULL OR b.comid IS NULL OR l IS DISTINCT FROM b.nextdownid""",
}
