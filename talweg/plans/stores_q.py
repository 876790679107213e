"""Queries over sources (s), sinks (k), models (m), caches (c) and streams (w) of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions.common import finite, station_id
from talweg.functions.ranks import interpolated, order_statistics
from talweg.operators import model as mo
from talweg.operators.parts import Parts
from talweg.plans import views as v
from talweg.plans import workflow as wf
from talweg.plans.network_q import _GAUGE, g12_gauge_edges
from talweg.plans.relational_q import NAMES
from talweg.session import Scratch
from talweg.sources import stores
from talweg.sources.tables import table
from talweg.streaming import flows

S = SparkSession


def s6_gauges_keep_first(spark: S, d: str) -> DataFrame:
    """The gauge list with one row per station, the first delivered."""
    g = table(spark, d, "gages").withColumn("staid", station_id("staid"))
    return g.withColumn("_rn", F.row_number().over(Window.partitionBy("staid").orderBy("row_id"))).filter("_rn = 1").select("staid", "row_id", "drain_sqkm")


def s7_attributes_present(spark: S, d: str) -> DataFrame:
    """Of the live reaches those with attributes, with the mean of the full column beside each value."""
    a = v.attributes(spark, d).select("comid", finite("aridity").alias("aridity"))
    mean = a.agg(F.avg("aridity").alias("full_mean"))
    return a.join(v.live(spark, d).select("comid"), "comid", "left_semi").crossJoin(F.broadcast(mean))


def s8_attributes_aligned(spark: S, d: str) -> DataFrame:
    return v.live(spark, d).select("comid").join(v.attributes(spark, d).select("comid", finite("meanp").alias("meanp")), "comid", "left")


def s9_attributes_of_two_stores(spark: S, d: str) -> DataFrame:
    a = v.attributes(spark, d)
    return v.live(spark, d).select("comid").join(a.select("comid", "ndvi"), "comid", "left").join(a.select("comid", "porosity"), "comid", "left").select("comid", finite("ndvi").alias("ndvi"), finite("porosity").alias("porosity"))


def s11_merged_statistics(spark: S, d: str) -> DataFrame:
    """Statistics by variable, of the first zone that has them."""
    t = table(spark, d, "attribute_stats")
    return t.groupBy("attr_name").agg(F.min_by("stat_mean", F.struct("zone_id", "computed_at", "stat_mean")).alias("mean"), F.min("zone_id").alias("zone_id"))


def s13_gauge_edges_pruned(spark: S, d: str) -> DataFrame:
    """The edges of three gauges out of a store with one partition per gauge."""
    path = Scratch(spark).path("gauges")
    stores.write_gauge_edges(g12_gauge_edges(spark, d), path)
    return stores.read_gauge_edges(spark, path, ["00000001", "00000002", "00000003", "nowhere"]).select("staid", "down", "up")


def s15_time_axes(spark: S, d: str) -> DataFrame:
    u = table(spark, d, "region").select("r_regionkey", F.concat(F.when(F.col("r_regionkey") % 2 == 0, "days").otherwise("hours"), F.lit(" since 19"), (F.col("r_regionkey") + 80).cast("string"), F.lit("-01-01 00:00:00")).alias("u"))
    return u.select("r_regionkey", stores.time_axis(F.col("u")).alias("a")).select("r_regionkey", "a.epoch", "a.step")


def s16_axis_faults(spark: S, d: str) -> DataFrame:
    return stores.hourly_axis_faults(v.hourly(spark, d), "id", "ts")


def s17_window(spark: S, d: str) -> DataFrame:
    """Lateral inflow of some reaches over ten days; a reach that the store lacks gets 0.001."""
    ids = spark.createDataFrame([(1,), (2,), (3,), (10_000_000,)], "comid long")
    return stores.read_window(v.qr(spark, d), ids, "comid", "day", "qr", "1995-03-01", "1995-03-10", 0.001)


def s18_daily_inflow(spark: S, d: str) -> DataFrame:
    return v.hourly(spark, d).groupBy("id", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("value"), F.count("*").alias("hours"))


def s21_observations(spark: S, d: str) -> DataFrame:
    return v.pairs(spark, d).filter(F.col("day").between("2000-01-01", "2004-12-31")).select("staid", "day", "obs")


def s20_test_window(spark: S, d: str) -> DataFrame:
    """Three whole days of hours of every user that has any in them."""
    return v.hourly(spark, d).filter("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-13 00:00:00'")


def s23_zone_pruned(spark: S, d: str) -> DataFrame:
    """Two zones out of a store with one partition per zone: the others are never read."""
    path = Scratch(spark).path("zones")
    v.attributes(spark, d).select("comid", finite("aridity").alias("aridity"), "zone_id").repartition("zone_id").write.partitionBy("zone_id").parquet(path)
    return spark.read.schema("comid bigint, aridity double, zone_id string").parquet(path).filter(F.col("zone_id").isin("Z0001", "Z0002"))


def s32_contains(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "daily_obs").select(station_id("gage_id").alias("staid")).distinct().withColumn("_f", F.lit(True))
    g = table(spark, d, "gages").select(station_id("staid").alias("staid")).distinct()
    return g.join(o, "staid", "left").select("staid", F.coalesce("_f", F.lit(False)).alias("has_record"))


def m4_parameter_summary(spark: S, d: str) -> DataFrame:
    """Percentiles of the physical parameters that the head gives over the whole network."""
    from talweg.functions.physics import RANGES, denormalize

    p = m1_head(spark, d).select(denormalize(F.col("n"), *RANGES["n"]).alias("n"), denormalize(F.col("q_spatial"), *RANGES["q_spatial"]).alias("q_spatial"), denormalize(F.col("p_spatial"), *RANGES["p_spatial"], True).alias("p_spatial"))
    long = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).alias("x")) for c in p.columns])).alias("s")).select("s.*")
    return order_statistics(long, ["parameter"], "x", {f"p{p}": interpolated(p / 100) for p in (5, 50, 95)}).drop("n")


def s24_arrays_as_series(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "pretrain_rows").select("row_id", F.col("target_hourly_m3s").cast("array<double>").alias("x"))
    return stores.series_of_arrays(r, "row_id", "x")


def s26_rain_or_zero(spark: S, d: str) -> DataFrame:
    """Hourly rain of every user on one day, 0 where none was read."""
    day = v.hourly(spark, d).filter("cast(ts as date) = date'2024-01-10'").select("id", F.hour("ts").alias("hour"), "value")
    grid = v.hourly(spark, d).select("id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(day, ["id", "hour"], "left").select("id", "hour", F.coalesce(finite("value"), F.lit(0.0)).alias("rain"))


def s27_coverage(spark: S, d: str) -> DataFrame:
    return v.reach(spark, d).join(v.qr(spark, d).select("comid").distinct(), "comid", "left_semi").agg(F.count("*").alias("n"))


def s28_paired_hours(spark: S, d: str) -> DataFrame:
    """Flow and rain of the same hours, either may be missing."""
    h = v.hourly(spark, d)
    a = h.filter("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("basin"), "ts", F.col("value").alias("flow"))
    b = h.filter("id % 2 = 1").select(F.floor(F.col("id") / 2).alias("basin"), "ts", F.col("value").alias("rain"))
    return a.join(b, ["basin", "ts"], "full")


def s29_state_of_day(spark: S, d: str) -> DataFrame:
    """The state of every reach on one day; reaches without inflow on it start from the floor, which makes the cache whole."""
    q = v.qr(spark, d).groupBy("day", "comid").agg(F.sum("qr").alias("q_state"))
    ids = v.reach(spark, d).select("comid")
    cold = ids.select(F.lit("1995-06-15").cast("date").alias("day"), "comid", F.lit(1e-4).alias("q_state"))
    whole = q.unionByName(cold.join(q, ["day", "comid"], "left_anti"))
    return stores.state_of_day(whole, ids, "1995-06-15")


def s30_one_field(spark: S, d: str) -> DataFrame:
    return v.attributes(spark, d).select("comid", "porosity")


def s33_probe_plan(spark: S, d: str) -> DataFrame:
    """Duplicates of (round, comid) in a probe plan; none if it is sound."""
    p = v.reach(spark, d).select(F.pmod("comid", F.lit(7)).alias("round"), F.pmod("comid", F.lit(100)).alias("comid"))
    return p.groupBy("round", "comid").agg(F.count("*").alias("n")).filter("n > 1")


def k1_graph_store(spark: S, d: str) -> DataFrame:
    """A graph written and read again: its edges with both reaches' lengths."""
    r = v.reach(spark, d)
    path = Scratch(spark).path("graph")
    stores.write_graph(r.select("comid", "length_m"), r.filter("parent is not null").select(F.col("parent").alias("down"), F.col("comid").alias("up")), path)
    reach, edge = stores.read_graph(spark, path)
    return edge.join(reach.select(F.col("comid").alias("up"), "length_m"), "up").select("down", "up", "length_m")


def k6_padded_series(spark: S, d: str) -> DataFrame:
    path = Scratch(spark).path("padded")
    stores.write_padded_series(v.pairs(spark, d).select("staid", "day", "obs"), "staid", "day", "obs", "1980-01-01", path)
    return spark.read.parquet(path).groupBy("staid").agg(F.count("*").alias("days"), F.count("obs").alias("read"))


def k11_tidy_csv(spark: S, d: str) -> DataFrame:
    path = Scratch(spark).path("loss")
    v.gauge(spark, d).select("staid", "comid").write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema("staid string, comid bigint").option("header", True).csv(path)


def c3_cached_baseline(spark: S, d: str) -> DataFrame:
    """A result kept under the key of what it is made of, then found again."""
    from talweg.plans.scores_q import a1_summed_inflow

    root, key = Scratch(spark).path("cache"), wf.cache_key("summed-1", {"tables": d}, wf.Config())
    wf.resolve_or_build(spark, root, key, lambda: a1_summed_inflow(spark, d))
    return wf.resolve_or_build(spark, root, key, lambda: spark.range(0))[0]


def _standard(spark: S, d: str) -> DataFrame:
    a = v.attributes(spark, d).select("comid", *[finite(c).alias(c) for c in NAMES])
    s = a.agg(*[F.avg(c).alias(f"m_{c}") for c in NAMES], *[F.stddev_pop(c).alias(f"s_{c}") for c in NAMES])
    return a.crossJoin(F.broadcast(s)).select("comid", *[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in NAMES])


def m1_head(spark: S, d: str) -> DataFrame:
    """Routing parameters of every reach from its attributes, from seeded weights."""
    return mo.predict(_standard(spark, d), "comid", NAMES, ["n", "q_spatial", "p_spatial"], mo.init_head(len(NAMES), 3))


def m3_disaggregate(spark: S, d: str) -> DataFrame:
    """Hourly flow from each station day's mean; the mean of the hours is the day's."""
    r = table(spark, d, "pretrain_rows").select("row_id", finite("daily_q_m3s").alias("q"), F.array_repeat(F.lit(0.0), 24).alias("rain"))
    h = mo.disaggregate(r, ["row_id"], "q", "rain", mo.init_head(25, 24))
    return h.select("row_id", (F.aggregate("hours", F.lit(0.0), lambda a, x: a + x) / 24 / v.CFS).alias("mean_cfs"))


def m5_training_losses(spark: S, d: str) -> DataFrame:
    """Three gradient steps of the head over whole basins of the reach forest, a task each, towards flow routed with known parameters."""
    from talweg.plans.network_q import reach_paths

    steps = 6
    base = reach_paths(spark, d).filter("hops >= 0").select(F.col("id").alias("comid"), F.get("path", F.size("path") - 1).alias("basin"))
    r = v.reach(spark, d).join(base, "comid").withColumns({"a1": F.col("slope") * 50, "a2": F.col("length_m") / 5000, "slope": F.greatest("slope", F.lit(1e-3))})
    r = r.withColumn("lateral", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: 1 + F.sin(t + F.pmod(F.col("comid"), F.lit(5)))))
    r = r.withColumn("observed", F.transform("lateral", lambda x: x * F.lit(3.0)))
    _, losses = mo.train(r.select("basin", "comid", "parent", "length_m", "slope", "a1", "a2", "lateral", "observed"), "basin", mo.init_head(2, 3, hidden=4, layers=1), mo.routing_loss(["a1", "a2"], steps), steps=3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step int, loss double")


def w1_pooled_stream(spark: S, d: str) -> DataFrame:
    """Daily means from 9 o'clock on of the event stream."""
    e = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    s = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return flows.run_to_end(spark, flows.pool_days_stream(s, "user_id", "ts", "value", 9), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "value", "hours")


def w2_sessions_stream(spark: S, d: str) -> DataFrame:
    """Runs of a user's events without a day's gap."""
    e = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    s = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return flows.run_to_end(spark, flows.sessions_stream(s, "user_id", "ts"), "complete").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def _routed_stream(spark: S, d: str) -> tuple[DataFrame, DataFrame, Parts]:
    """Flow of the stream batch by batch, the network with its basins, and its parts."""
    from talweg.plans.network_q import reach_paths

    paths = reach_paths(spark, d)
    ids = paths.select(F.col("id").alias("comid"), F.col("root").alias("basin"))
    net = v.reach(spark, d).join(ids, "comid").select("basin", "comid", "parent", "length_m", F.greatest("slope", F.lit(1e-3)).alias("slope"))
    scratch = Scratch(spark)
    net = scratch.save(net, "network")
    hours = net.select("comid", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t")).withColumn("q_lateral", 1 + F.sin(F.col("t") + F.pmod(F.col("comid"), F.lit(4))) / 2)
    for k in range(3):
        hours.filter((F.col("t") >= 4 * k) & (F.col("t") < 4 * k + 4)).coalesce(1).write.parquet(scratch.path(f"in/b{k}"))
    stream = spark.readStream.schema("comid long, t int, q_lateral double").option("maxFilesPerTrigger", 1).parquet(scratch.path("in/*"))
    parts = Parts(net, paths)
    return flows.route_stream_in_parts(stream, parts), net, parts


def w3_routing_stream(spark: S, d: str) -> DataFrame:
    """Hours of lateral inflow in three files, routed as they come, with state carried over; all basins, whole or in sub-basins."""
    got, net, _ = _routed_stream(spark, d)
    each = got.join(net.select("basin", "comid"), "comid").select("basin", "comid", F.explode(F.arrays_zip("hours", "r")).alias("x"))
    return each.select("basin", "comid", F.col("x.hours").alias("t"), F.col("x.r").alias("q"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "skmcw" and k[1].isdigit()}

_A = f"WITH {v.SQL['live']}, {v.SQL['attributes']}"
_F = "CASE WHEN isfinite({0}) THEN {0} END AS {0}"
SQL = {
    "s6_gauges_keep_first": f"SELECT {v._pad('staid')} AS staid, row_id, drain_sqkm FROM gages QUALIFY row_number() OVER (PARTITION BY {v._pad('staid')} ORDER BY row_id) = 1",
    "s7_attributes_present": _A + f", a AS (SELECT comid, {_F.format('aridity')} FROM attributes) SELECT comid, aridity, (SELECT avg(aridity) FROM a) AS full_mean FROM a WHERE comid IN (SELECT comid FROM live)",
    "s8_attributes_aligned": _A + f" SELECT live.comid, {_F.format('meanp')} FROM live LEFT JOIN attributes USING (comid)",
    "s9_attributes_of_two_stores": _A + f" SELECT live.comid, {_F.format('ndvi')}, {_F.format('porosity')} FROM live LEFT JOIN attributes USING (comid)",
    "s11_merged_statistics": "SELECT attr_name, arg_min(stat_mean, (zone_id, computed_at, stat_mean)) AS mean, min(zone_id) AS zone_id FROM attribute_stats GROUP BY attr_name",
    "s13_gauge_edges_pruned": _GAUGE + " SELECT staid, down, up FROM ge WHERE staid IN ('00000001', '00000002', '00000003')",
    "s15_time_axes": "SELECT r_regionkey, CAST('19' || (r_regionkey + 80) || '-01-01' AS DATE) AS epoch, CASE WHEN r_regionkey % 2 = 0 THEN 'days' ELSE 'hours' END AS step FROM region",
    "s16_axis_faults": v.sql("hourly") + ", b AS (SELECT id, ts, lag(ts) OVER (PARTITION BY id ORDER BY ts) AS p FROM hourly) SELECT id, ts FROM b WHERE CASE WHEN p IS NULL THEN hour(ts) <> 0 ELSE ts <> p + INTERVAL 1 HOUR END",
    "s17_window": v.sql("qr") + ", w AS (SELECT * FROM qr WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-03-10') SELECT comid, day, qr FROM w WHERE comid IN (1, 2, 3) UNION ALL SELECT i, day, CAST(0.001 AS DOUBLE) FROM (VALUES (1), (2), (3), (10000000)) t(i) CROSS JOIN (SELECT DISTINCT day FROM w) WHERE i NOT IN (SELECT comid FROM qr)",
    "s18_daily_inflow": v.sql("hourly") + " SELECT id, CAST(ts AS DATE) AS day, avg(value) AS value, count(*) AS hours FROM hourly GROUP BY ALL",
    "s21_observations": v.sql("pairs") + " SELECT staid, day, obs FROM pairs WHERE day BETWEEN DATE '2000-01-01' AND DATE '2004-12-31'",
    "s20_test_window": v.sql("hourly") + " SELECT id, ts, value FROM hourly WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'",
    "s23_zone_pruned": f"WITH {v.SQL['attributes']} SELECT comid, {_F.format('aridity')}, zone_id FROM attributes WHERE zone_id IN ('Z0001', 'Z0002')",
    "s32_contains": f"SELECT DISTINCT {v._pad('staid')} AS staid, {v._pad('staid')} IN (SELECT {v._pad('gage_id')} FROM daily_obs) AS has_record FROM gages",
    "s24_arrays_as_series": "WITH e AS (SELECT row_id, unnest(range(0, len(target_hourly_m3s))) AS i, CAST(unnest(target_hourly_m3s) AS DOUBLE) AS x FROM pretrain_rows) SELECT row_id, DATE '1980-01-01' + CAST(i AS INTEGER) AS day, CASE WHEN isfinite(x) THEN x END AS value FROM e",
    "s26_rain_or_zero": v.sql("hourly") + ", g AS (SELECT DISTINCT id, h FROM hourly CROSS JOIN range(24) r(h)) SELECT g.id, CAST(h AS INTEGER) AS hour, coalesce(value, CAST(0 AS DOUBLE)) AS rain FROM g LEFT JOIN hourly x ON x.id = g.id AND CAST(x.ts AS DATE) = DATE '2024-01-10' AND hour(x.ts) = h",
    "s27_coverage": v.sql("reach", "qr") + " SELECT count(*) AS n FROM reach WHERE comid IN (SELECT comid FROM qr)",
    "s28_paired_hours": v.sql("hourly") + ", a AS (SELECT id // 2 AS basin, ts, value AS flow FROM hourly WHERE id % 2 = 0), b AS (SELECT id // 2 AS basin, ts, value AS rain FROM hourly WHERE id % 2 = 1) SELECT basin, ts, flow, rain FROM a FULL JOIN b USING (basin, ts)",
    "s29_state_of_day": v.sql("reach", "qr") + " SELECT r.comid, coalesce(q.qr, CAST(1e-4 AS DOUBLE)) AS q_state FROM reach r LEFT JOIN (SELECT * FROM qr WHERE day = DATE '1995-06-15') q USING (comid)",
    "s30_one_field": f"WITH {v.SQL['attributes']} SELECT comid, porosity FROM attributes",
    "s33_probe_plan": v.sql("reach") + " SELECT comid % 7 AS round, comid % 100 AS comid, count(*) AS n FROM reach GROUP BY 1, 2 HAVING count(*) > 1",
    "k1_graph_store": v.sql("reach") + " SELECT parent AS down, comid AS up, length_m FROM reach WHERE parent IS NOT NULL",
    "k6_padded_series": v.sql("pairs") + " SELECT staid, date_diff('day', DATE '1980-01-01', max(day)) + 1 AS days, count(obs) AS read FROM pairs GROUP BY staid",
    "k11_tidy_csv": v.sql("gauge") + " SELECT staid, comid FROM gauge",
    "c3_cached_baseline": _GAUGE + f", {v.SQL['qr']} SELECT staid, day, sum(qr) AS q FROM gr JOIN qr USING (comid) GROUP BY ALL",
    "m3_disaggregate": "SELECT row_id, CASE WHEN isfinite(daily_q_m3s) THEN CAST(daily_q_m3s AS DOUBLE) / CAST(0.028316846592 AS DOUBLE) END AS mean_cfs FROM pretrain_rows",
    "w1_pooled_stream": "SELECT user_id, time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '2024-01-01 09:00:00') AS start, avg(value) AS value, count(value) AS hours FROM events GROUP BY ALL",
    "w2_sessions_stream": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS \"first\", max(ts) AS \"last\", count(*) AS n FROM s GROUP BY user_id, s",
}
