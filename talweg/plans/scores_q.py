"""Queries over aggregates (a) and time series (t) of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions.common import finite, safe_div
from talweg.functions.ranks import interpolated, nearest, order_statistics, upper_middle
from talweg.operators import scores as sc
from talweg.operators import series as se
from talweg.operators.network import summed_above
from talweg.operators.relational import differences
from talweg.plans import views as v
from talweg.plans.network_q import _GAUGE, _gauge_reach
from talweg.plans.relational_q import _CLEAN, _clean_days
from talweg.session import Scratch
from talweg.sources.tables import table

S = SparkSession


def a1_summed_inflow(spark: S, d: str) -> DataFrame:
    """Per gauge and day the inflow of all reaches above; a gauge's sets may overlap."""
    return summed_above(v.reach(spark, d), v.gauge(spark, d), v.qr(spark, d), "qr", ["day"]).withColumnRenamed("total", "q")


def a2_scores(spark: S, d: str) -> DataFrame:
    return sc.scores(v.pairs(spark, d), "staid")


def a2_baseline_scores(spark: S, d: str) -> DataFrame:
    """The whole chain: upstream sets, summed inflow, observations, scores."""
    p = a1_summed_inflow(spark, d).withColumnRenamed("q", "pred").join(v.obs(spark, d), ["staid", "day"])
    return sc.scores(p, "staid").select("staid", "nse", "rmse", "kge", "bias")


def a6_finite_means(spark: S, d: str) -> DataFrame:
    return v.attributes(spark, d).groupBy("zone_id").agg(*[F.avg(finite(c)).alias(c) for c in ("aridity", "meanp", "ndvi")])


def _daily(spark: S, d: str) -> DataFrame:
    return v.hourly(spark, d).groupBy("id", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("value"))


def a7_daily_means(spark: S, d: str) -> DataFrame:
    return _daily(spark, d)


def a8_pooled_days(spark: S, d: str) -> DataFrame:
    return se.pool_days(v.hourly(spark, d), "id", "ts", "value", 9)


def _metric_lists(spark: S, d: str) -> DataFrame:
    m = a2_scores(spark, d)
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("nse", "kge", "rmse")])).alias("s")).select("s.*").filter("x is not null")


def a9_summary(spark: S, d: str) -> DataFrame:
    m = Scratch(spark).save(_metric_lists(spark, d), "metrics")
    return order_statistics(m, ["metric"], "x", {"q25": nearest(0.25), "median": nearest(0.5), "q75": nearest(0.75)}).join(m.groupBy("metric").agg(F.avg("x").alias("mean")), "metric")


def a10_run_summary(spark: S, d: str) -> DataFrame:
    m = Scratch(spark).save(_metric_lists(spark, d), "metrics")
    return order_statistics(m, ["metric"], "x", {"median": upper_middle}).join(m.groupBy("metric").agg(F.avg("x").alias("mean")), "metric")


def a11_floor_share(spark: S, d: str) -> DataFrame:
    share = v.reach(spark, d).agg(F.avg((F.col("length_m") <= 500).cast("double")).alias("at_floor"))
    return order_statistics(v.reach(spark, d), [], "length_m", {"median": interpolated(0.5)}).drop("n").crossJoin(F.broadcast(share))


def a12_observation_spread(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).groupBy("staid").agg(F.when(F.count("obs") < 2, 0.0).otherwise(F.stddev_pop("obs")).alias("sd"))


def a13_merged_sums(spark: S, d: str) -> DataFrame:
    """Partial sums of chunks (years), added up: equal to one pass over everything."""
    part = v.pairs(spark, d).groupBy("staid", F.year("day").alias("chunk")).agg(F.sum("pred").alias("s"), F.count("*").alias("n"))
    return part.groupBy("staid").agg(F.sum("s").alias("total"), F.sum("n").alias("n"))


def a14_gradient_sums(spark: S, d: str) -> DataFrame:
    g = v.qr(spark, d).withColumn("g", F.col("qr") - 25)
    return g.groupBy("comid").agg(F.sum(F.abs("g")).alias("sum_abs"), F.sum("g").alias("sum_g"), F.count("*").alias("n"))


def a15_recombined_mean(spark: S, d: str) -> DataFrame:
    part = v.pairs(spark, d).groupBy("staid").agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("l"), F.count("*").alias("n"))
    return part.agg((F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("loss"))


def a16_station_mae(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).groupBy("staid").agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("mae"))


def a17_mae_after_warmup(spark: S, d: str) -> DataFrame:
    p = v.pairs(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("staid").orderBy("day")))
    return p.filter("i > 5").agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("mae"), F.count("*").alias("n"))


def a18_scaled_loss(spark: S, d: str) -> DataFrame:
    sd = F.stddev_pop("obs").over(Window.partitionBy("staid")) + 0.1
    e = (F.col("pred") - F.col("obs")) / sd
    return v.pairs(spark, d).withColumn("e", e * e).agg(F.avg("e").alias("loss"))


def a19_hydrograph_loss(spark: S, d: str) -> DataFrame:
    return sc.moments(v.pairs(spark, d), ["staid"]).select(sc.hydrograph_loss().alias("l")).agg(F.avg("l").alias("loss"))


def a20_component_loss(spark: S, d: str) -> DataFrame:
    return sc.moments(v.pairs(spark, d), ["staid"]).select(sc.component_loss().alias("l")).agg(F.avg("l").alias("loss"))


def a21_reconciliation(spark: S, d: str) -> DataFrame:
    """Per station the upper median of the ratio, the correlation, the days in common and whether it is kept."""
    p = v.pairs(spark, d).filter("pred > 0 and obs > 0")
    p = Scratch(spark).save(p.withColumn("ratio", F.col("pred") / F.col("obs")), "ratios")
    g = p.groupBy("staid").agg(F.corr("pred", "obs").alias("r"), F.var_pop("pred").alias("vp"), F.var_pop("obs").alias("vo"), F.count("*").alias("n_overlap_days"))
    r = F.when((F.col("vp") <= 0) | (F.col("vo") <= 0), 0.0).otherwise(F.col("r"))
    g = g.join(order_statistics(p, ["staid"], "ratio", {"m": upper_middle}).drop("n"), "staid")
    enough = F.col("n_overlap_days") >= 30
    g = g.select("staid", F.when(enough, F.col("m")).alias("median_ratio"), F.when(enough, r).alias("correlation"), "n_overlap_days")
    return g.withColumn("is_kept", F.coalesce(F.col("median_ratio").between(0.9, 1.1) & (F.col("correlation") >= 0.9), F.lit(False)))


def a22_correlation(spark: S, d: str) -> DataFrame:
    m = sc.moments(v.pairs(spark, d), ["staid"])
    return m.select("staid", F.coalesce(safe_div(F.col("cov"), F.sqrt("vp") * F.sqrt("vo")), F.lit(0.0)).alias("r"))


def a23_shape_error(spark: S, d: str) -> DataFrame:
    s = _clean_days(spark, d).withColumn("t", F.aggregate("h", F.lit(0.0), lambda a, x: a + x)).filter("t > 0")
    return s.select("staid", F.explode("h").alias("x"), "t").select("staid", F.pow(F.col("x") / F.col("t") - 1 / 24.0, 2).alias("e")).groupBy("staid").agg(F.avg("e").alias("mse"))


def a24_scores_with_eps(spark: S, d: str) -> DataFrame:
    m = sc.moments(v.pairs(spark, d), ["staid"])
    return m.select("staid", F.when(F.col("n") >= 2, sc.nse(1e-6)).alias("nse"), F.when((F.col("n") >= 3) & (F.col("mo") != 0) & (F.col("vo") != 0), sc.kge(1e-6)).alias("kge"))


def a25_nse_of_long_records(spark: S, d: str) -> DataFrame:
    return sc.moments(v.pairs(spark, d), ["staid"]).select("staid", F.when(F.col("n") >= 100, sc.nse()).alias("nse"))


def a26_tau_sweep(spark: S, d: str) -> DataFrame:
    """Per user the shift of the daily means that fits the unshifted means best.

    Each hour is copied once per shift (36 of them, 0 to 35 hours), pooled and scored; nothing is paired with all.
    """
    h = v.hourly(spark, d).withColumn("tau", F.explode(F.sequence(F.lit(0), F.lit(35))))
    day = (F.col("ts") - F.make_dt_interval(F.lit(0), F.col("tau"), F.lit(0), F.lit(0))).cast("date")
    pred = h.groupBy("id", "tau", day.alias("day")).agg(F.avg("value").alias("pred"))
    p = pred.join(_daily(spark, d).withColumnRenamed("value", "obs"), ["id", "day"])
    m = sc.moments(p, ["id", "tau"]).filter("n >= 5").select("id", "tau", F.round(sc.nse(), 9).alias("nse")).filter("nse is not null")
    return m.groupBy("id").agg(F.max_by("tau", F.struct("nse", -F.col("tau"))).alias("tau"), F.max("nse").alias("nse"))


def a27_rank_correlation(spark: S, d: str) -> DataFrame:
    return sc.spearman(v.pairs(spark, d), "pred", "obs", ["staid"])


def a28_flashiness(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("staid").orderBy("day")
    p = v.pairs(spark, d).withColumn("dq", F.col("pred") - F.lag("pred").over(w))
    return p.groupBy("staid").agg(F.corr("pred", "obs").alias("r"), (F.stddev_pop("dq") / (F.abs(F.avg("pred")) + 1e-6)).alias("flashiness"))


def a29_relative_spread(spark: S, d: str) -> DataFrame:
    """Spread over arms (the years) relative to their mean."""
    y = v.pairs(spark, d).groupBy("staid", F.year("day").alias("arm")).agg(F.avg("pred").alias("x"))
    return y.groupBy("staid").agg(((F.max("x") - F.min("x")) / (F.abs(F.avg("x")) + 1e-9)).alias("spread"))


def a30_percentiles(spark: S, d: str) -> DataFrame:
    a = v.attributes(spark, d).select("zone_id", finite("aridity").alias("x")).filter("x is not null")
    return order_statistics(a, ["zone_id"], "x", {f"p{p}": interpolated(p / 100) for p in (5, 25, 50, 75, 95)}).drop("n")


def _profile(spark: S, d: str) -> DataFrame:
    return v.attributes(spark, d).select("comid", finite("log10_uparea").alias("x"), finite("aridity").alias("y")).filter("x > -100 and y >= 0")


def _edges_of(p: DataFrame, n: int) -> DataFrame:
    names = {f"e{i}": interpolated(i / n) for i in range(1, n)}
    return order_statistics(p, [], "x", names).select(F.array(*names).alias("e"))


def a31_binned_profile(spark: S, d: str) -> DataFrame:
    p = _profile(spark, d)
    b = p.crossJoin(F.broadcast(_edges_of(p, 10))).withColumn("bin", F.size(F.filter("e", lambda e: e <= F.col("x"))))
    b = Scratch(spark).save(b, "bins")
    middle = lambda c: order_statistics(b, ["bin"], c, {f"{c}_median": interpolated(0.5)})
    return middle("x").join(middle("y").drop("n"), "bin")


def a32_loglog_slope(spark: S, d: str) -> DataFrame:
    return _profile(spark, d).filter("y > 0").agg(F.regr_slope(F.log("y"), F.col("x")).alias("slope"), F.count("*").alias("n"))


def a33_vector_similarity(spark: S, d: str) -> DataFrame:
    """Cosine and sign agreement of each vector with the mean vector of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "a"))
    e = e.withColumn("a", F.col("a").cast("double"))
    m = e.groupBy("label", "i").agg(F.avg("a").alias("b"))
    j = e.join(m, ["label", "i"])
    return j.groupBy("vec_id").agg((F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))).alias("cosine"), F.avg((F.signum("a") == F.signum("b")).cast("double")).alias("agree"))


def _gauge_window(spark: S, d: str) -> DataFrame:
    """(staid, year, own, swapped): two compositions of a loss per window."""
    p = v.pairs(spark, d).groupBy("staid", F.year("day").alias("win"))
    return p.agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("own"), F.avg(F.abs(F.col("pred") * 1.1 - F.col("obs"))).alias("swapped"))


def a34_paired_statistics(spark: S, d: str) -> DataFrame:
    g = _gauge_window(spark, d).withColumn("delta", F.col("swapped") - F.col("own"))
    m, s, n = F.avg("delta"), F.stddev_samp("delta"), F.count("*")
    return g.groupBy("staid").agg(m.alias("mean"), s.alias("sd"), (s / F.sqrt(n)).alias("se"), safe_div(m, s / F.sqrt(n)).alias("t"), F.avg((F.col("delta") > 0).cast("double")).alias("share"))


def a35_concentration(spark: S, d: str) -> DataFrame:
    """The share of the total that the ten largest contributions carry."""
    g = _gauge_window(spark, d).groupBy("staid").agg(F.sum(F.col("swapped") - F.col("own")).alias("c"))
    top = g.orderBy(F.desc(F.abs("c")), "staid").limit(10).agg(F.sum("c").alias("top"))
    return g.agg(F.sum("c").alias("total")).crossJoin(top).select((F.col("top") / F.col("total")).alias("share"))


def a36_quintile_medians(spark: S, d: str) -> DataFrame:
    p = _profile(spark, d)
    b = p.crossJoin(F.broadcast(_edges_of(p, 5))).withColumn("quintile", F.size(F.filter("e", lambda e: e < F.col("x"))))
    return order_statistics(b, ["quintile"], "y", {"y_median": interpolated(0.5)}).drop("n")


def a37_pivot(spark: S, d: str) -> DataFrame:
    long = _gauge_window(spark, d).select("staid", "win", F.explode(F.create_map(F.lit("own"), "own", F.lit("swapped"), "swapped")).alias("composition", "loss"))
    return long.groupBy("staid", "win").pivot("composition", ["own", "swapped"]).agg(F.first("loss"))


def a38_surface(spark: S, d: str) -> DataFrame:
    """Mean loss on a grid and whether a point is within 5 % of the minimum."""
    w = F.explode(F.array(*[F.lit(float(k)) for k in (-1, 0, 1)]))
    p = v.pairs(spark, d).withColumn("log2_alpha", w).withColumn("log2_beta", w)
    loss = F.abs(F.col("pred") * F.pow(F.lit(2.0), F.col("log2_alpha")) + F.col("log2_beta") - F.col("obs"))
    g = p.groupBy("log2_alpha", "log2_beta").agg(F.avg(loss).alias("mean_loss"))
    return g.crossJoin(g.agg(F.min("mean_loss").alias("low"))).select("log2_alpha", "log2_beta", "mean_loss", (F.col("mean_loss") <= F.col("low") * 1.05).alias("near_min"))


def a39_warmup_strata(spark: S, d: str) -> DataFrame:
    """Error by tercile of the stations' level and by warm-up."""
    p = v.pairs(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("staid").orderBy("day")))
    lv = p.groupBy("staid").agg(F.avg("obs").alias("level"))
    e = order_statistics(lv, [], "level", {"a": interpolated(0.33), "b": interpolated(0.66)}).select(F.array("a", "b").alias("e"))
    s = lv.crossJoin(F.broadcast(e)).select("staid", F.when(F.col("level") <= F.col("e")[0], "small").when(F.col("level") <= F.col("e")[1], "mid").otherwise("large").alias("stratum"))
    w = p.join(s, "staid").withColumn("warmup", F.explode(F.array(*[F.lit(k) for k in (0, 5, 30)]))).filter("i > warmup")
    w = Scratch(spark).save(w.select("stratum", "warmup", F.abs(F.col("pred") - F.col("obs")).alias("x")), "errors")
    return order_statistics(w, ["stratum", "warmup"], "x", {"median": interpolated(0.5)}).drop("n").join(w.groupBy("stratum", "warmup").agg(F.avg("x").alias("mean")), ["stratum", "warmup"])


def a40_area_histogram(spark: S, d: str) -> DataFrame:
    a = F.col("drain_sqkm")
    cut = F.when(a <= 100, "<100").when(a <= 500, "100-500").when(a <= 1000, "500-1k").when(a <= 5000, "1k-5k").when(a <= 10000, "5k-10k").otherwise(">=10k")
    return table(spark, d, "gages").groupBy(cut.alias("bin")).agg(F.count("*").alias("n"))


def a41_water_years(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).groupBy("staid", F.year(F.add_months("day", 3)).alias("water_year")).agg(F.count("obs").alias("n"))


def a42_verdicts(spark: S, d: str) -> DataFrame:
    m = v.pairs(spark, d).filter("obs > 0").groupBy("staid").agg(F.median(F.abs(F.col("pred") / F.col("obs") - 1)).alias("error"))
    return m.select("staid", "error", F.when(F.col("error") < 0.1, "recovered").when(F.col("error") < 0.5, "partly").otherwise("not").alias("verdict"))


def a43_detection(spark: S, d: str) -> DataFrame:
    """Is a probe's mean shift above the noise of two baselines (the 99th percentile of their distance) and above 5 % of the baseline's mean?

    The probe is ``pred``, the first baseline ``obs``, the second the same in steps of a tenth.
    """
    p = v.pairs(spark, d).withColumns({"e": F.col("pred") - F.col("obs"), "noise": F.abs(F.col("obs") - F.floor(F.col("obs") * 10) / 10)})
    m = p.groupBy("staid").agg(F.avg("e").alias("mean"), F.max(F.abs("e")).alias("peak"), F.percentile("noise", F.lit(0.99)).alias("noise"), (F.avg("obs") * 0.05).alias("band"))
    return m.select("staid", "mean", "peak", "noise", "band", ((F.abs("mean") > F.col("noise")) & (F.abs("mean") > F.col("band"))).alias("detected"))


def a44_grid_medians(spark: S, d: str) -> DataFrame:
    p = _profile(spark, d).withColumns({"bx": F.floor("x"), "by": F.floor(F.col("y") * 2)})
    return order_statistics(p, ["bx", "by"], "y", {"y_median": interpolated(0.5)})


def a45_lock_differences(spark: S, d: str) -> DataFrame:
    """Zones whose number of rows differs between two loads."""
    t = table(spark, d, "reach_attributes").groupBy("zone_id", (F.year("loaded_at") < 2024).alias("old")).agg(F.count("*").cast("string").alias("n"))
    return differences(t.filter("old"), t.filter("not old"), "zone_id", "n")


def a46_network_medians(spark: S, d: str) -> DataFrame:
    """The median slope above each gauge, and its rank correlation with the size of its network."""
    m = _gauge_reach(spark, d).join(v.reach(spark, d).select("comid", "slope"), "comid").groupBy("staid").agg(F.median("slope").alias("m"), F.count("*").alias("k"))
    return sc.spearman_of_all(m, "m", "k")


def a47_plan_report(spark: S, d: str) -> DataFrame:
    from talweg.plans.network_q import g25_plan_stats

    return g25_plan_stats(spark, d).select(F.format_string("%d reaches, %d pieces, %d split, %d stretched", "n", "sum_pieces", "n_split", "n_stretched").alias("report"))


def t1_day_axis(spark: S, d: str) -> DataFrame:
    """Every day of a station's record, with its reading or null."""
    p = v.pairs(spark, d)
    axis = p.groupBy("staid").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("staid", F.explode(se.day_axis(F.col("a"), F.col("b"))).alias("day"))
    return axis.join(p.select("staid", "day", "obs"), ["staid", "day"], "left")


def t2_window_starts(spark: S, d: str) -> DataFrame:
    """A seeded start of a window of 30 days for each station with a longer record."""
    r = v.pairs(spark, d).groupBy("staid").agg(F.min("day").alias("a"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("n")).filter("n >= 30")
    h = F.conv(F.substring(F.md5("staid"), 1, 8), 16, 10).cast("bigint")
    return r.select("staid", F.date_add("a", F.when(F.col("n") == 30, 0).otherwise(F.pmod(h, F.col("n") - 30)).cast("int")).alias("start"))


def t3_window_hours(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_size").alias("rho")).distinct().select("rho", ((F.col("rho") - 1) * 24).alias("hours"))


def t4_tiles(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).groupBy("staid", F.floor(F.datediff("day", F.lit("1980-01-01").cast("date")) / 15).alias("tile")).agg(F.count("*").alias("n"), F.max("obs").alias("obs"))


def t5_repeated_hours(spark: S, d: str) -> DataFrame:
    return se.to_hourly(_daily(spark, d), "id", "day", "value")


def t6_linear_hours(spark: S, d: str) -> DataFrame:
    return se.to_hourly(_daily(spark, d), "id", "day", "value", "linear")


def t7_quadratic_hours(spark: S, d: str) -> DataFrame:
    return se.to_hourly(_daily(spark, d), "id", "day", "value", "quadratic")


def t8_with_context(spark: S, d: str) -> DataFrame:
    return _daily(spark, d).filter(F.col("day").between(F.date_sub(F.lit("2024-01-10").cast("date"), 1), F.date_add(F.lit("2024-01-20").cast("date"), 1)))


def t9_area_pool(spark: S, d: str) -> DataFrame:
    c = _clean_days(spark, d).select("row_id", F.posexplode("h").alias("pos", "value"))
    return se.area_pool(c, "row_id", "pos", "value", 7)


def t10_rain_scores(spark: S, d: str) -> DataFrame:
    return se.standardise(v.hourly(spark, d), "id", "value", log=True).select("id", "ts", "z")


def t11_temperature_scores(spark: S, d: str) -> DataFrame:
    return se.standardise(v.hourly(spark, d), "id", "value").select("id", "ts", "z")


def t12_day_runs(spark: S, d: str) -> DataFrame:
    return se.day_runs(v.pairs(spark, d), "staid", "day", 3)


def t13_blended_shapes(spark: S, d: str) -> DataFrame:
    s = _clean_days(spark, d).withColumn("t", F.aggregate("h", F.lit(0.0), lambda a, x: a + x)).filter("t > 0").withColumn("day", F.date_add(F.lit("1980-01-01").cast("date"), F.col("day_index")))
    s = s.groupBy("staid", "day").agg(F.min_by("h", "row_id").alias("h"), F.min_by("t", "row_id").alias("t")).withColumn("shape", F.transform("h", lambda x: x / F.col("t")))
    b = se.boundary_blend(s, "staid", "day", "shape", 0.5)
    return b.select("staid", "day", F.col("shape")[0].alias("first"), F.col("shape")[12].alias("noon"), F.col("shape")[23].alias("last"))


def t14_softmax_shapes(spark: S, d: str) -> DataFrame:
    """Daily volumes spread over the hours by a softmax of the readings; the daily mean is kept."""
    h = v.hourly(spark, d).withColumn("day", F.col("ts").cast("date"))
    s = se.softmax(h.withColumn("logit", F.col("value") / 100), ["id", "day"], "logit")
    w = Window.partitionBy("id", "day")
    return s.select("id", "ts", (F.avg("value").over(w) * F.count("*").over(w) * F.col("share")).alias("q"))


def t15_softmax_chunks(spark: S, d: str) -> DataFrame:
    h = v.hourly(spark, d).withColumn("chunk", F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3))
    return se.softmax(h.withColumn("logit", F.col("value") / 100), ["id", "chunk"], "logit").select("id", "ts", "share")


def t17_aligned_days(spark: S, d: str) -> DataFrame:
    """Pairs without the first and the last day of a record and without a warm-up of three days."""
    w = Window.partitionBy("staid")
    p = v.pairs(spark, d).withColumns({"i": F.row_number().over(w.orderBy("day")), "n": F.count("*").over(w)})
    return p.filter("i > 4 and i < n").select("staid", "day", "pred", "obs")


def t18_day_vectors(spark: S, d: str) -> DataFrame:
    """One vector of 24 hours a day, 0 where an hour is missing."""
    h = v.hourly(spark, d).select("id", F.col("ts").cast("date").alias("day"), F.hour("ts").alias("h"), "value")
    g = h.groupBy("id", "day").agg(F.map_from_entries(F.collect_list(F.struct("h", "value"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return g.select("id", "day", F.aggregate(vec, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(vec).alias("n"))


def t21_decay(spark: S, d: str) -> DataFrame:
    p = v.pairs(spark, d).withColumn("day_idx", F.row_number().over(Window.partitionBy("staid").orderBy("day")) - 1)
    e = F.abs(F.col("pred") - F.col("obs"))
    p = Scratch(spark).save(p.select("day_idx", e.alias("x")), "errors")
    return order_statistics(p, ["day_idx"], "x", {"median": interpolated(0.5)}).drop("n").join(p.groupBy("day_idx").agg(F.avg("x").alias("mean")), "day_idx")


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "at" and k[1].isdigit()}

_P = v.sql("pairs")
_D = v.sql("hourly") + ", daily AS (SELECT id, CAST(ts AS DATE) AS day, avg(value) AS value FROM hourly GROUP BY ALL)"
_N = _D + """, nb AS (SELECT id, day, value, coalesce(CASE WHEN lag(day) OVER w = day - 1 THEN lag(value) OVER w END, value) AS bef, coalesce(CASE WHEN lead(day) OVER w = day + 1 THEN lead(value) OVER w END, value) AS aft FROM daily WINDOW w AS (PARTITION BY id ORDER BY day)),
hh AS (SELECT id, day, CAST(hour AS INTEGER) AS hour, value, bef, aft, (hour + CAST(0.5 AS DOUBLE)) / 24 - CAST(0.5 AS DOUBLE) AS x FROM nb CROSS JOIN range(24) r(hour))"""
_M = _P + ", m AS (SELECT staid, count(*) AS n, avg(pred) AS mp, avg(obs) AS mo, var_pop(pred) AS vp, var_pop(obs) AS vo, covar_pop(pred, obs) AS cov, avg((pred - obs) * (pred - obs)) AS mse FROM pairs GROUP BY staid)"
_NSE = "1 - mse / nullif(vo, 0)"
_KGE = "1 - sqrt(pow(cov / nullif(sqrt(vp) * sqrt(vo), 0) - 1, 2) + pow(sqrt(vp) / nullif(sqrt(vo), 0) - 1, 2) + pow(mp / nullif(mo, 0) - 1, 2))"
_SCORES = _M + f""", rk AS (SELECT staid, pred, obs, row_number() OVER (PARTITION BY staid ORDER BY pred) AS rp, row_number() OVER (PARTITION BY staid ORDER BY obs) AS ro, count(*) OVER (PARTITION BY staid) AS n FROM pairs),
fv AS (SELECT staid, sum(pred) FILTER (rp > round(n * CAST(0.98 AS DOUBLE))) AS ph, sum(obs) FILTER (ro > round(n * CAST(0.98 AS DOUBLE))) AS oh, sum(pred) FILTER (rp <= round(n * CAST(0.3 AS DOUBLE))) AS pl, sum(obs) FILTER (ro <= round(n * CAST(0.3 AS DOUBLE))) AS ol FROM rk GROUP BY staid),
sc AS (SELECT staid, {_NSE} AS nse, sqrt(mse) AS rmse, {_KGE} AS kge, mp - mo AS bias, 100 * (ph - oh) / nullif(oh, 0) AS fhv, 100 * (pl - ol) / nullif(ol, 0) AS flv FROM m JOIN fv USING (staid))"""
_LISTS = _SCORES + ", l AS (SELECT 'nse' AS metric, nse AS x FROM sc UNION ALL SELECT 'kge', kge FROM sc UNION ALL SELECT 'rmse', rmse FROM sc), s AS (SELECT metric, avg(x) AS mean, count(x) AS n, list_sort(list(x) FILTER (x IS NOT NULL)) AS v FROM l GROUP BY metric)"
_NR = "v[CAST(round((n - 1) * CAST({0} AS DOUBLE)) AS BIGINT) + 1]"
_PROF = f"WITH {v.SQL['attributes']}, p AS (SELECT comid, log10_uparea AS x, aridity AS y FROM attributes WHERE isfinite(log10_uparea) AND log10_uparea > -100 AND isfinite(aridity) AND aridity >= 0)"
_GW = _P + ", gw AS (SELECT staid, year(day) AS win, avg(abs(pred - obs)) AS own, avg(abs(pred * CAST(1.1 AS DOUBLE) - obs)) AS swapped FROM pairs GROUP BY ALL)"
_EPS = "CAST(0.1 AS DOUBLE)"
_R = f"cov / (sqrt(vp + {_EPS}) * sqrt(vo + {_EPS})) - 1"
_A = f"sqrt(vp + {_EPS}) / sqrt(vo + {_EPS}) - 1"
_B = f"mp / (mo + {_EPS}) - 1"
_AVGRANK = "(rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / CAST(2 AS DOUBLE))"

SQL = {
    "a1_summed_inflow": _GAUGE + f", {v.SQL['qr']} SELECT staid, day, sum(qr) AS q FROM gr JOIN qr USING (comid) GROUP BY ALL",
    "a2_scores": _SCORES + " SELECT * FROM sc",
    "a2_baseline_scores": _GAUGE + f", {v.SQL['qr']}, {v.SQL['obs']}, b AS (SELECT staid, day, sum(qr) AS pred FROM gr JOIN qr USING (comid) GROUP BY ALL), j AS (SELECT * FROM b JOIN obs USING (staid, day)), m AS (SELECT staid, avg(pred) AS mp, avg(obs) AS mo, var_pop(pred) AS vp, var_pop(obs) AS vo, covar_pop(pred, obs) AS cov, avg((pred - obs) * (pred - obs)) AS mse FROM j GROUP BY staid) SELECT staid, {_NSE} AS nse, sqrt(mse) AS rmse, {_KGE} AS kge, mp - mo AS bias FROM m",
    "a6_finite_means": f"WITH {v.SQL['attributes']} SELECT zone_id, " + ", ".join(f"avg({c}) FILTER (isfinite({c})) AS {c}" for c in ("aridity", "meanp", "ndvi")) + " FROM attributes GROUP BY zone_id",
    "a7_daily_means": _D + " SELECT id, day, value FROM daily",
    "a8_pooled_days": v.sql("hourly") + " SELECT id, CAST(ts - INTERVAL 9 HOUR AS DATE) AS day, avg(value) AS value, count(value) AS hours FROM hourly GROUP BY ALL",
    "a9_summary": _LISTS + f" SELECT metric, mean, n, {_NR.format(0.25)} AS q25, {_NR.format(0.5)} AS median, {_NR.format(0.75)} AS q75 FROM s",
    "a10_run_summary": _LISTS + " SELECT metric, v[n // 2 + 1] AS median, mean, n FROM s",
    "a11_floor_share": v.sql("reach") + " SELECT median(length_m) AS median, avg(CASE WHEN length_m <= 500 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS at_floor FROM reach",
    "a12_observation_spread": _P + " SELECT staid, CASE WHEN count(obs) < 2 THEN CAST(0 AS DOUBLE) ELSE stddev_pop(obs) END AS sd FROM pairs GROUP BY staid",
    "a13_merged_sums": _P + " SELECT staid, sum(pred) AS total, count(*) AS n FROM pairs GROUP BY staid",
    "a14_gradient_sums": v.sql("qr") + " SELECT comid, sum(abs(qr - 25)) AS sum_abs, sum(qr - 25) AS sum_g, count(*) AS n FROM qr GROUP BY comid",
    "a15_recombined_mean": _P + " SELECT avg(abs(pred - obs)) AS loss FROM pairs",
    "a16_station_mae": _P + " SELECT staid, avg(abs(pred - obs)) AS mae FROM pairs GROUP BY staid",
    "a17_mae_after_warmup": _P + ", i AS (SELECT *, row_number() OVER (PARTITION BY staid ORDER BY day) AS i FROM pairs) SELECT avg(abs(pred - obs)) AS mae, count(*) AS n FROM i WHERE i > 5",
    "a18_scaled_loss": _P + ", e AS (SELECT (pred - obs) / (stddev_pop(obs) OVER (PARTITION BY staid) + CAST(0.1 AS DOUBLE)) AS e FROM pairs) SELECT avg(e * e) AS loss FROM e",
    "a19_hydrograph_loss": _M + f" SELECT avg(1 - 1 / (1 + mse * n / (vo * n + {_EPS})) + sqrt(pow({_R}, 2) + pow({_A}, 2) + pow({_B}, 2))) AS loss FROM m",
    "a20_component_loss": _M + f" SELECT avg(least(pow({_R}, 2) + pow({_A}, 2) + pow({_B}, 2), 10)) AS loss FROM m",
    "a21_reconciliation": _P + ", g AS (SELECT staid, list_sort(list(pred / obs))[count(*) // 2 + 1] AS m, CASE WHEN var_pop(pred) <= 0 OR var_pop(obs) <= 0 THEN 0 ELSE corr(pred, obs) END AS r, count(*) AS n FROM pairs WHERE pred > 0 AND obs > 0 GROUP BY staid) SELECT staid, CASE WHEN n >= 30 THEN m END AS median_ratio, CASE WHEN n >= 30 THEN r END AS correlation, n AS n_overlap_days, coalesce(n >= 30 AND m BETWEEN CAST(0.9 AS DOUBLE) AND CAST(1.1 AS DOUBLE) AND r >= CAST(0.9 AS DOUBLE), false) AS is_kept FROM g",
    "a22_correlation": _M + " SELECT staid, coalesce(cov / nullif(sqrt(vp) * sqrt(vo), 0), CAST(0 AS DOUBLE)) AS r FROM m",
    "a23_shape_error": f"WITH s AS (SELECT {v._pad('staid')} AS staid, CAST(target_hourly_m3s AS DOUBLE[]) AS h FROM pretrain_rows WHERE {_CLEAN}), t AS (SELECT staid, unnest(h) AS x, list_sum(h) AS t FROM s WHERE list_sum(h) > 0) SELECT staid, avg(pow(x / t - 1 / CAST(24 AS DOUBLE), 2)) AS mse FROM t GROUP BY staid",
    "a24_scores_with_eps": _M + " SELECT staid, CASE WHEN n >= 2 THEN 1 - mse / (vo + CAST(1e-6 AS DOUBLE)) END AS nse, CASE WHEN n >= 3 AND mo <> 0 AND vo <> 0 THEN 1 - sqrt(pow(cov / nullif(sqrt(vp) * sqrt(vo), 0) - 1, 2) + pow(sqrt(vp) / (sqrt(vo) + CAST(1e-6 AS DOUBLE)) - 1, 2) + pow(mp / (mo + CAST(1e-6 AS DOUBLE)) - 1, 2)) END AS kge FROM m",
    "a25_nse_of_long_records": _M + f" SELECT staid, CASE WHEN n >= 100 THEN {_NSE} END AS nse FROM m",
    "a26_tau_sweep": _D + ", h AS (SELECT id, ts, value, CAST(unnest(range(36)) AS INTEGER) AS tau FROM hourly), pr AS (SELECT id, tau, CAST(ts - to_hours(tau) AS DATE) AS day, avg(value) AS pred FROM h GROUP BY ALL), j AS (SELECT pr.id, tau, pred, value AS obs FROM pr JOIN daily ON daily.id = pr.id AND daily.day = pr.day), m AS (SELECT id, tau, round(1 - avg((pred - obs) * (pred - obs)) / nullif(var_pop(obs), 0), 9) AS nse FROM j GROUP BY id, tau HAVING count(*) >= 5) SELECT id, tau, nse FROM m WHERE nse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY nse DESC, tau) = 1",
    "a27_rank_correlation": _P + f", r AS (SELECT staid, {_AVGRANK.format(g='staid', c='pred')} AS a, {_AVGRANK.format(g='staid', c='obs')} AS b FROM pairs) SELECT staid, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY staid",
    "a28_flashiness": _P + ", q AS (SELECT *, pred - lag(pred) OVER (PARTITION BY staid ORDER BY day) AS dq FROM pairs) SELECT staid, corr(pred, obs) AS r, stddev_pop(dq) / (abs(avg(pred)) + CAST(1e-6 AS DOUBLE)) AS flashiness FROM q GROUP BY staid",
    "a29_relative_spread": _P + ", y AS (SELECT staid, year(day) AS y, avg(pred) AS x FROM pairs GROUP BY ALL) SELECT staid, (max(x) - min(x)) / (abs(avg(x)) + CAST(1e-9 AS DOUBLE)) AS spread FROM y GROUP BY staid",
    "a30_percentiles": f"WITH {v.SQL['attributes']} SELECT zone_id, " + ", ".join(f"quantile_cont(aridity, {p}) AS {n}" for n, p in (("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))) + " FROM attributes WHERE isfinite(aridity) GROUP BY zone_id",
    "a31_binned_profile": _PROF + ", e AS (SELECT [" + ", ".join(f"quantile_cont(x, {i / 10})" for i in range(1, 10)) + "] AS e FROM p), b AS (SELECT x, y, len(list_filter(e, lambda q: q <= x)) AS bin FROM p CROSS JOIN e) SELECT CAST(bin AS INTEGER) AS bin, median(x) AS x_median, median(y) AS y_median, count(*) AS n FROM b GROUP BY bin",
    "a32_loglog_slope": _PROF + " SELECT regr_slope(ln(y), x) AS slope, count(*) AS n FROM p WHERE y > 0",
    "a33_vector_similarity": "WITH e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings), m AS (SELECT label, i, avg(a) AS b FROM e GROUP BY ALL) SELECT vec_id, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cosine, avg(CASE WHEN sign(a) = sign(b) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS agree FROM e JOIN m USING (label, i) GROUP BY vec_id",
    "a34_paired_statistics": _GW + " SELECT staid, avg(swapped - own) AS mean, stddev_samp(swapped - own) AS sd, stddev_samp(swapped - own) / sqrt(count(*)) AS se, avg(swapped - own) / nullif(stddev_samp(swapped - own) / sqrt(count(*)), 0) AS t, avg(CASE WHEN swapped - own > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS share FROM gw GROUP BY staid",
    "a35_concentration": _GW + ", c AS (SELECT staid, sum(swapped - own) AS c FROM gw GROUP BY staid) SELECT (SELECT sum(c) FROM (SELECT c FROM c ORDER BY abs(c) DESC, staid LIMIT 10)) / sum(c) AS share FROM c",
    "a36_quintile_medians": _PROF + ", e AS (SELECT [" + ", ".join(f"quantile_cont(x, {i / 5})" for i in range(1, 5)) + "] AS e FROM p) SELECT CAST(len(list_filter(e, lambda q: q < x)) AS INTEGER) AS quintile, median(y) AS y_median FROM p CROSS JOIN e GROUP BY 1",
    "a37_pivot": _GW + " SELECT staid, win, own, swapped FROM gw",
    "a38_surface": _P + ", k AS (SELECT CAST(unnest([-1, 0, 1]) AS DOUBLE) AS k), g AS (SELECT a.k AS log2_alpha, b.k AS log2_beta, avg(abs(pred * pow(CAST(2 AS DOUBLE), a.k) + b.k - obs)) AS mean_loss FROM pairs CROSS JOIN k a CROSS JOIN k b GROUP BY ALL) SELECT *, mean_loss <= (SELECT min(mean_loss) FROM g) * CAST(1.05 AS DOUBLE) AS near_min FROM g",
    "a39_warmup_strata": _P + ", i AS (SELECT *, row_number() OVER (PARTITION BY staid ORDER BY day) AS i FROM pairs), lv AS (SELECT staid, avg(obs) AS lv FROM pairs GROUP BY staid), e AS (SELECT quantile_cont(lv, 0.33) AS lo, quantile_cont(lv, 0.66) AS hi FROM lv), s AS (SELECT staid, CASE WHEN lv <= lo THEN 'small' WHEN lv <= hi THEN 'mid' ELSE 'large' END AS stratum FROM lv CROSS JOIN e) SELECT stratum, warmup, avg(abs(pred - obs)) AS mean, median(abs(pred - obs)) AS median FROM i JOIN s USING (staid) CROSS JOIN (VALUES (0), (5), (30)) w(warmup) WHERE i > warmup GROUP BY ALL",
    "a40_area_histogram": "SELECT CASE WHEN drain_sqkm <= 100 THEN '<100' WHEN drain_sqkm <= 500 THEN '100-500' WHEN drain_sqkm <= 1000 THEN '500-1k' WHEN drain_sqkm <= 5000 THEN '1k-5k' WHEN drain_sqkm <= 10000 THEN '5k-10k' ELSE '>=10k' END AS bin, count(*) AS n FROM gages GROUP BY 1",
    "a41_water_years": _P + " SELECT staid, CAST(year(day + INTERVAL 3 MONTH) AS INTEGER) AS water_year, count(obs) AS n FROM pairs GROUP BY ALL",
    "a42_verdicts": _P + ", m AS (SELECT staid, median(abs(pred / obs - 1)) AS error FROM pairs WHERE obs > 0 GROUP BY staid) SELECT staid, error, CASE WHEN error < CAST(0.1 AS DOUBLE) THEN 'recovered' WHEN error < CAST(0.5 AS DOUBLE) THEN 'partly' ELSE 'not' END AS verdict FROM m",
    "a43_detection": _P + ", m AS (SELECT staid, avg(pred - obs) AS mean, max(abs(pred - obs)) AS peak, quantile_cont(abs(obs - floor(obs * 10) / 10), 0.99) AS noise, avg(obs) * CAST(0.05 AS DOUBLE) AS band FROM pairs GROUP BY staid) SELECT *, abs(mean) > noise AND abs(mean) > band AS detected FROM m",
    "a44_grid_medians": _PROF + " SELECT CAST(floor(x) AS BIGINT) AS bx, CAST(floor(y * 2) AS BIGINT) AS by, median(y) AS y_median, count(*) AS n FROM p GROUP BY 1, 2",
    "a45_lock_differences": "WITH t AS (SELECT zone_id, year(loaded_at) < 2024 AS old, CAST(count(*) AS VARCHAR) AS n FROM reach_attributes GROUP BY ALL) SELECT zone_id, a.n AS \"left\", b.n AS \"right\", CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS state FROM (SELECT * FROM t WHERE old) a FULL JOIN (SELECT * FROM t WHERE NOT old) b USING (zone_id) WHERE a.n IS DISTINCT FROM b.n",
    "a46_network_medians": _GAUGE + f", m AS (SELECT staid, median(slope) AS m, count(*) AS k FROM gr JOIN reach USING (comid) GROUP BY staid), r AS (SELECT {_AVGRANK.format(g='1', c='m')} AS a, {_AVGRANK.format(g='1', c='k')} AS b FROM m) SELECT corr(a, b) AS rho, count(*) AS n FROM r",
    "a47_plan_report": "",
    "t1_day_axis": _P + ", r AS (SELECT staid, min(day) AS a, max(day) AS b FROM pairs GROUP BY staid), x AS (SELECT staid, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r) SELECT staid, day, obs FROM x LEFT JOIN pairs USING (staid, day)",
    "t2_window_starts": _P + ", r AS (SELECT staid, min(day) AS a, date_diff('day', min(day), max(day)) + 1 AS n FROM pairs GROUP BY staid) SELECT staid, a + CAST(CASE WHEN n = 30 THEN 0 ELSE CAST('0x' || substr(md5(staid), 1, 8) AS BIGINT) % (n - 30) END AS INTEGER) AS start FROM r WHERE n >= 30",
    "t3_window_hours": "SELECT DISTINCT p_size AS rho, (p_size - 1) * 24 AS hours FROM part",
    "t4_tiles": _P + " SELECT staid, CAST(floor(date_diff('day', DATE '1980-01-01', day) / CAST(15 AS DOUBLE)) AS BIGINT) AS tile, count(*) AS n, max(obs) AS obs FROM pairs GROUP BY ALL",
    "t5_repeated_hours": _N + " SELECT id, day, hour, value FROM hh",
    "t6_linear_hours": _N + " SELECT id, day, hour, greatest(CASE WHEN x < 0 THEN (1 + x) * value - x * bef ELSE (1 - x) * value + x * aft END, 0) AS value FROM hh",
    "t7_quadratic_hours": _N + " SELECT id, day, hour, greatest(value + CAST(0.5 AS DOUBLE) * (aft - bef) * x + CAST(0.5 AS DOUBLE) * (bef - 2 * value + aft) * x * x, 0) AS value FROM hh",
    "t8_with_context": _D + " SELECT id, day, value FROM daily WHERE day BETWEEN DATE '2024-01-09' AND DATE '2024-01-21'",
    "t9_area_pool": f"WITH c AS (SELECT row_id, unnest(range(0, 24)) AS pos, unnest(CAST(target_hourly_m3s AS DOUBLE[])) AS value FROM pretrain_rows WHERE {_CLEAN}), b AS (SELECT *, 24 / CAST(7 AS DOUBLE) AS s FROM c CROSS JOIN range(7) r(bin)) SELECT row_id, bin, sum(value * (least(pos + 1, (bin + 1) * s) - greatest(pos, bin * s)) / s) AS value FROM b WHERE least(pos + 1, (bin + 1) * s) - greatest(pos, bin * s) > CAST(1e-12 AS DOUBLE) GROUP BY ALL",
    "t10_rain_scores": v.sql("hourly") + ", l AS (SELECT id, ts, ln(1 + value) AS x FROM hourly) SELECT id, ts, CASE WHEN stddev_pop(x) OVER w < 1e-6 THEN 0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM l WINDOW w AS (PARTITION BY id)",
    "t11_temperature_scores": v.sql("hourly") + " SELECT id, ts, CASE WHEN stddev_pop(value) OVER w < 1e-6 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM hourly WINDOW w AS (PARTITION BY id)",
    "t12_day_runs": _P + ", r AS (SELECT staid, day, day - CAST(row_number() OVER (PARTITION BY staid ORDER BY day) AS INTEGER) AS run FROM pairs), c AS (SELECT *, CAST((row_number() OVER (PARTITION BY staid, run ORDER BY day) - 1) // 3 AS BIGINT) AS chunk FROM r) SELECT staid, day, run, chunk FROM c QUALIFY count(*) OVER (PARTITION BY staid, run, chunk) = 3",
    "t13_blended_shapes": f"""WITH s AS (SELECT {v._pad('staid')} AS staid, DATE '1980-01-01' + day_index AS day, CAST(target_hourly_m3s AS DOUBLE[]) AS h FROM pretrain_rows WHERE {_CLEAN} AND list_sum(CAST(target_hourly_m3s AS DOUBLE[])) > 0 QUALIFY row_number() OVER (PARTITION BY {v._pad('staid')}, day_index ORDER BY row_id) = 1),
p AS (SELECT staid, day, h[1] / list_sum(h) AS p0, h[13] / list_sum(h) AS p12, h[24] / list_sum(h) AS p23 FROM s),
b AS (SELECT *, coalesce(p0 + ((p0 + CASE WHEN lag(day) OVER w = day - 1 THEN lag(p23) OVER w END) / 2 - p0) * CAST(0.5 AS DOUBLE), p0) AS q0, coalesce(p23 + ((p23 + CASE WHEN lead(day) OVER w = day + 1 THEN lead(p0) OVER w END) / 2 - p23) * CAST(0.5 AS DOUBLE), p23) AS q23 FROM p WINDOW w AS (PARTITION BY staid ORDER BY day))
SELECT staid, day, q0 AS "first", p12 * (1 - q0 - q23) / (1 - p0 - p23 + CAST(1e-6 AS DOUBLE)) AS noon, q23 AS "last" FROM b""",
    "t14_softmax_shapes": v.sql("hourly") + ", e AS (SELECT id, ts, value, exp(value / 100 - max(value / 100) OVER (PARTITION BY id, CAST(ts AS DATE))) AS e FROM hourly) SELECT id, ts, avg(value) OVER w * count(*) OVER w * e / sum(e) OVER w AS q FROM e WINDOW w AS (PARTITION BY id, CAST(ts AS DATE))",
    "t15_softmax_chunks": v.sql("hourly") + ", c AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / CAST(3 AS DOUBLE)) AS BIGINT) AS k FROM hourly), e AS (SELECT *, exp(value / 100 - max(value / 100) OVER (PARTITION BY id, k)) AS e FROM c) SELECT id, ts, e / sum(e) OVER (PARTITION BY id, k) AS share FROM e",
    "t17_aligned_days": _P + " SELECT staid, day, pred, obs FROM pairs QUALIFY row_number() OVER (PARTITION BY staid ORDER BY day) > 4 AND row_number() OVER (PARTITION BY staid ORDER BY day) < count(*) OVER (PARTITION BY staid)",
    "t18_day_vectors": v.sql("hourly") + " SELECT id, CAST(ts AS DATE) AS day, sum(value) AS total, 24 AS n FROM hourly GROUP BY ALL",
    "t21_decay": _P + ", i AS (SELECT *, CAST(row_number() OVER (PARTITION BY staid ORDER BY day) - 1 AS INTEGER) AS day_idx FROM pairs) SELECT day_idx, avg(abs(pred - obs)) AS mean, median(abs(pred - obs)) AS median FROM i GROUP BY day_idx",
}
from talweg.plans.network_q import _PLAN  # noqa: E402

SQL["a47_plan_report"] = _PLAN + " SELECT count(*) || ' reaches, ' || sum(pieces) || ' pieces, ' || count_if(pieces > 1) || ' split, ' || count_if(length_eff > length_m + 1e-3) || ' stretched' AS report FROM plan"
