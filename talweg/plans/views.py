"""The roles that the tables play in the queries of the river engine, in Spark and in SQL.

reach     a forest over ``part``: comid = p_partkey + 1, downstream comid div 4, length and slope from size and price
qr        lateral inflow per reach and day from ``lineitem``
gauge     from ``supplier``; obs: its daily observations from ``orders``
hourly    user hours of ``events``, read as cubic feet and given in cubic metres
network   the live reaches of ``flowlines`` with their downstream links
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.common import finite, station_id
from talweg.operators.flowlines import downstream_links, reach_status
from talweg.sources.tables import table


#: Cubic metres per cubic foot.
CFS = 0.028316846592


def reach(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_partkey") + 1
    return table(spark, d, "part").select(
        c.alias("comid"), F.nullif(F.floor(c / 4), F.lit(0)).alias("parent"), (F.col("p_size") * 100.0).alias("length_m"),
        ((F.col("p_retailprice") - 899) * 1e-4).alias("slope"), (F.col("p_size") * 10.0).alias("uparea_km2"),
    )


def qr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") + 1).alias("comid"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("qr"))


def gauge(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").agg(F.count("*").alias("_n"))
    return table(spark, d, "supplier").crossJoin(n).select(
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("staid"), (F.pmod(F.col("s_suppkey") * 7, F.col("_n")) + 1).alias("comid"),
        F.abs("s_acctbal").alias("drain_sqkm"), (F.col("s_acctbal") > 0).alias("da_valid"),
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").agg(F.count("*").alias("_n"))
    o = table(spark, d, "orders").crossJoin(n)
    staid = F.lpad(F.pmod(F.col("o_custkey"), F.col("_n")).cast("string"), 8, "0")
    return o.groupBy(staid.alias("staid"), F.col("o_orderdate").cast("date").alias("day")).agg((F.sum("o_totalprice") / 1e4).alias("obs"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg((F.avg("value") * CFS).alias("value"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return downstream_links(table(spark, d, "flowlines"))


def live(spark: SparkSession, d: str) -> DataFrame:
    return reach_status(table(spark, d, "flowlines")).filter(~F.col("is_deleted"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(staid, day, pred, obs): the two records of a station, each day once, finite values only."""
    q = table(spark, d, "pretrain_rows").select(station_id("staid").alias("staid"), F.col("obs_day").alias("day"), finite("daily_q_m3s").alias("pred")).filter("pred is not null").groupBy("staid", "day").agg(F.max("pred").alias("pred"))
    o = table(spark, d, "daily_obs").select(station_id("gage_id").alias("staid"), F.col("obs_day").alias("day"), finite("streamflow").alias("obs")).filter("obs is not null").groupBy("staid", "day").agg(F.max("obs").alias("obs"))
    return q.join(o, ["staid", "day"])


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each comid in ``reach_attributes``."""
    t = table(spark, d, "reach_attributes")
    names = [c for c in t.columns if c not in ("comid", "loaded_at")]
    return t.groupBy("comid").agg(F.max(F.struct("loaded_at", *names)).alias("m")).select("comid", *[F.col(f"m.{c}").alias(c) for c in names])


def _pad(c: str) -> str:
    bare = f"regexp_replace(trim({c}), '^[A-Za-z]+(-|:|_+)', '')"
    return f"CASE WHEN length({bare}) < 8 THEN lpad({bare}, 8, '0') ELSE {bare} END"


SQL = {
    "reach": "reach AS (SELECT p_partkey + 1 AS comid, nullif((p_partkey + 1) // 4, 0) AS parent, CAST(p_size AS DOUBLE) * 100 AS length_m, CAST((p_retailprice - 899) * CAST(1e-4 AS DOUBLE) AS DOUBLE) AS slope, CAST(p_size AS DOUBLE) * 10 AS uparea_km2 FROM part)",
    "qr": "qr AS (SELECT l_partkey + 1 AS comid, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qr FROM lineitem GROUP BY ALL)",
    "gauge": "gauge AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS staid, (s_suppkey * 7) % (SELECT count(*) FROM part) + 1 AS comid, abs(s_acctbal) AS drain_sqkm, s_acctbal > 0 AS da_valid FROM supplier)",
    "obs": "obs AS (SELECT lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 8, '0') AS staid, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / CAST(1e4 AS DOUBLE) AS obs FROM orders GROUP BY ALL)",
    "hourly": "hourly AS (SELECT user_id AS id, date_trunc('hour', ts) AS ts, avg(value) * CAST(0.028316846592 AS DOUBLE) AS value FROM events GROUP BY ALL)",
    "pairs": f"""pq AS (SELECT {_pad('staid')} AS staid, obs_day AS day, max(CAST(daily_q_m3s AS DOUBLE)) AS pred FROM pretrain_rows WHERE isfinite(daily_q_m3s) GROUP BY ALL),
po AS (SELECT {_pad('gage_id')} AS staid, obs_day AS day, max(streamflow) AS obs FROM daily_obs WHERE isfinite(streamflow) GROUP BY ALL),
pairs AS (SELECT staid, day, pred, obs FROM pq JOIN po USING (staid, day))""",
    "attributes": "attributes AS (SELECT * EXCLUDE (rn, loaded_at) FROM (SELECT *, row_number() OVER (PARTITION BY comid ORDER BY loaded_at DESC, zone_id DESC) AS rn FROM reach_attributes) WHERE rn = 1)",
    "closure": "closure AS (SELECT comid, comid AS anc, 0 AS hops, parent AS nxt FROM reach UNION ALL SELECT c.comid, r.comid, c.hops + 1, r.parent FROM closure c JOIN reach r ON r.comid = c.nxt)",
    "live": """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comid ORDER BY loaded_at DESC, fid DESC) AS rn FROM flowlines) WHERE rn = 1),
live AS (SELECT * FROM cur WHERE removed_at IS NULL)""",
}


def sql(*views: str, recursive: bool = False) -> str:
    """A WITH clause of the views named."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[v] for v in views)
