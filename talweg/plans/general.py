"""Queries p1, p3, p4 and p5 over the project's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.common import station_id, whole_number
from talweg.operators.flowlines import downstream_links, reach_status
from talweg.operators.hierarchy import descendants, hierarchy
from talweg.operators.references import count_by_period, reference_states
from talweg.operators.spatial import near, within
from talweg.operators.spikes import implausible
from talweg.plans.views import _pad
from talweg.sources.tables import table

NEAR_M = 1000.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gages within 1000 m of each other, and the catchment each lies in."""
    gages = table(spark, folder, "gages").select("row_id", "lat_gage", "lng_gage")
    pairs = near(gages, "row_id", "lat_gage", "lng_gage", NEAR_M).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = within(gages, "row_id", "lat_gage", "lng_gage", table(spark, folder, "catchments").select("comid", "geom"), "comid", "geom")
    return pairs.unionByName(inside.select(F.lit("within").alias("kind"), F.col("id").alias("id_a"), F.col("region_id").alias("id_b")))


def p1_near(spark: SparkSession, folder: str) -> DataFrame:
    """Only the pairs of gages within 1000 m of each other."""
    return near(table(spark, folder, "gages"), "row_id", "lat_gage", "lng_gage", NEAR_M).select("id_a", "id_b")


def _reach_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All references to reaches as (src_table, row_key, target, ref_time), and the reaches they may mean."""
    status = reach_status(table(spark, folder, "flowlines"))
    own = status.filter(~F.col("is_deleted")).select(F.lit("flowlines").alias("src_table"), F.col("comid").alias("row_key"), F.col("nextdownid").alias("target"), F.col("loaded_at").alias("ref_time"))
    gages = table(spark, folder, "gages").select(F.lit("gages").alias("src_table"), F.col("row_id").alias("row_key"), F.col("comid").alias("target"), F.col("loaded_at").alias("ref_time"))
    subs = table(spark, folder, "gage_subgraphs").select(
        F.lit("gage_subgraphs").alias("src_table"), F.col("sub_id").alias("row_key"), whole_number("gage_catchment").alias("target"), F.col("loaded_at").alias("ref_time")
    )
    refs = own.unionByName(gages).unionByName(subs).withColumn("target", F.when(F.col("target") > 0, F.col("target")))
    return refs, status.select("comid", "first_seen", "is_deleted")


def p3_states(spark: SparkSession, folder: str) -> DataFrame:
    refs, reaches = _reach_references(spark, folder)
    return reference_states(refs, reaches, {"target": "comid"}, "simple", "ref_time", "first_seen", "is_deleted")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to reaches that are missing, deleted or came later."""
    return p3_states(spark, folder).select("src_table", "row_key", "ref_state")


def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Their number per table and month of the referring row."""
    return count_by_period(p3_states(spark, folder), "src_table", "ref_time")


def _outlet_references(spark: SparkSession, folder: str, match: str) -> DataFrame:
    """Stations with the reach they name, looked up by both in the outlets of the subgraphs; a station may name no reach."""
    reach = lambda c: F.when(c > 0, c)
    refs = table(spark, folder, "gages").select("row_id", station_id("staid").alias("station"), reach(F.col("comid")).alias("reach"), "loaded_at")
    held = table(spark, folder, "gage_subgraphs").select(station_id("staid").alias("station"), reach(whole_number("gage_catchment")).alias("outlet"), F.col("loaded_at").alias("seen"))
    return reference_states(refs, held, {"station": "station", "reach": "outlet"}, match, "loaded_at", "seen").select("row_id", "ref_state")


def p3_partial(spark: SparkSession, folder: str) -> DataFrame:
    """References of two columns under MATCH PARTIAL: a station without a reach must be found by its id alone."""
    return _outlet_references(spark, folder, "partial")


def p3_full(spark: SparkSession, folder: str) -> DataFrame:
    """The same under MATCH FULL: a station without a reach is a broken reference."""
    return _outlet_references(spark, folder, "full")


def p3_simple(spark: SparkSession, folder: str) -> DataFrame:
    """The same under MATCH SIMPLE: a station without a reach is no reference."""
    return _outlet_references(spark, folder, "simple")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with spikes, stuck values, impossible readings or a wrong daily mean."""
    return p4_reasons(spark, folder).select("row_id")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows with what is wrong in them."""
    rows = table(spark, folder, "pretrain_rows").select("row_id", station_id("staid").alias("station"), "day_index", "target_hourly_m3s", "daily_q_m3s")
    return implausible(rows, "station", "row_id", "target_hourly_m3s", "daily_q_m3s", "day_index")


def p4_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that break a rule: impossible readings, or a daily value that is not their mean."""
    f = F.col("flags")
    flags = p4_reasons(spark, folder).select("row_id", f.contains("impossible").alias("impossible"), f.contains("mean_off").alias("mean_off"))
    return flags.filter("impossible or mean_off")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Outlet of every live reach and the number of steps to it."""
    links = downstream_links(table(spark, folder, "flowlines"))
    return hierarchy(links, "comid", "parent").select(F.col("id").alias("comid"), F.col("root").alias("root_comid"), "hops")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The whole path of every live reach, from itself to its outlet, as text."""
    links = downstream_links(table(spark, folder, "flowlines"))
    return hierarchy(links, "comid", "parent", with_paths=True).select(F.col("id").alias("comid"), F.array_join("path", ">").alias("path"))


def p5_upstream(spark: SparkSession, folder: str) -> DataFrame:
    """The number of reaches above every reach that has some, and the farthest of them in steps."""
    links = downstream_links(table(spark, folder, "flowlines"))
    above = hierarchy(links, "comid", "parent", sizes=True).filter("size > 1")
    return above.select(F.col("id").alias("comid"), (F.col("size") - 1).alias("n_above"), F.col("height").alias("farthest"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every reach with each reach above it and the steps between them."""
    links = downstream_links(table(spark, folder, "flowlines"))
    return descendants(hierarchy(links, "comid", "parent", with_paths=True)).select(F.col("ancestor").alias("comid"), F.col("id").alias("above"), "hops")


def p5_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found with no remainder left to one task, whatever the size: outlet and steps of every live reach, and how many reaches are above it."""
    links = downstream_links(table(spark, folder, "flowlines"))
    return hierarchy(links, "comid", "parent", finish_nodes=0, sizes=True).select(F.col("id").alias("comid"), F.col("root").alias("root_comid"), "hops", (F.col("size") - 1).alias("n_above"))


QUERIES = {f.__name__: f for f in (p1_found, p1_near, p3_found, p3_by_month, p3_simple, p3_partial, p3_full, p4_found, p4_reasons, p4_rules, p5_found, p5_paths, p5_upstream, p5_descendants, p5_rounds)}

_STATUS = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comid ORDER BY loaded_at DESC, fid DESC) AS rn,
                              min(loaded_at) OVER (PARTITION BY comid) AS first_seen FROM flowlines) WHERE rn = 1),
live AS (SELECT * FROM cur WHERE removed_at IS NULL)"""

_REFS = f"""{_STATUS},
subs AS (SELECT sub_id, loaded_at, try_cast(CASE WHEN regexp_full_match(trim(gage_catchment), '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+') THEN replace(gage_catchment, ',', '')
                                             ELSE trim(gage_catchment) END AS DOUBLE) AS t FROM gage_subgraphs),
refs AS (SELECT 'flowlines' AS src_table, comid AS row_key, nextdownid AS target, loaded_at AS ref_time FROM live
         UNION ALL SELECT 'gages', row_id, comid, loaded_at FROM gages
         UNION ALL SELECT 'gage_subgraphs', sub_id, CAST(t AS BIGINT), loaded_at FROM subs),
states AS (SELECT src_table, row_key, ref_time, CASE WHEN c.comid IS NULL THEN 'missing' WHEN c.removed_at IS NOT NULL THEN 'deleted'
                  WHEN c.first_seen > ref_time THEN 'late' END AS ref_state
           FROM refs LEFT JOIN cur c ON target = c.comid WHERE target > 0)"""

_OUTLETS = """subs AS (SELECT staid, loaded_at, try_cast(CASE WHEN regexp_full_match(trim(gage_catchment), '[+-]?[0-9]{1,3}(,[0-9]{3})+') THEN replace(gage_catchment, ',', '')
                              ELSE trim(gage_catchment) END AS DOUBLE) AS t FROM gage_subgraphs),
held AS (SELECT {pad_staid} AS s, CASE WHEN t > 0 THEN CAST(t AS BIGINT) END AS o, loaded_at AS seen FROM subs),
refs AS (SELECT row_id, {pad_staid} AS s, CASE WHEN comid > 0 THEN comid END AS c, loaded_at AS told FROM gages),
both_keys AS (SELECT s, o, min(seen) AS seen FROM held WHERE o IS NOT NULL GROUP BY s, o), one_key AS (SELECT s, min(seen) AS seen FROM held GROUP BY s),
whole AS (SELECT row_id, CASE WHEN h.s IS NULL THEN 'missing' WHEN h.seen > told THEN 'late' END AS ref_state FROM refs LEFT JOIN both_keys h ON h.s = refs.s AND h.o = refs.c WHERE c IS NOT NULL),
part AS (SELECT row_id, CASE WHEN h.s IS NULL THEN 'missing' WHEN h.seen > told THEN 'late' END AS ref_state FROM refs LEFT JOIN one_key h ON h.s = refs.s WHERE c IS NULL)""".replace("{pad_staid}", _pad("staid"))

_LINKS = f"""{_STATUS},
named AS (SELECT u, min(comid) AS by_comid FROM (SELECT comid, unnest([up1, up2, up3, up4]) AS u FROM live) WHERE u > 0 GROUP BY u),
want AS (SELECT l.comid, CASE WHEN l.nextdownid IS NULL THEN n.by_comid ELSE l.nextdownid END AS w FROM live l LEFT JOIN named n ON n.u = l.comid),
link AS (SELECT w.comid, l.comid AS parent FROM want w LEFT JOIN live l ON l.comid = w.w)"""

_TREE = f"""WITH RECURSIVE {_LINKS.strip()},
walk AS (SELECT comid AS node, comid AS root, 0 AS hops FROM link WHERE parent IS NULL
         UNION ALL SELECT l.comid, w.root, w.hops + 1 FROM walk w JOIN link l ON l.parent = w.node)"""

_FOUND = f"""{_TREE},
rest AS (SELECT comid, parent FROM link WHERE comid NOT IN (SELECT node FROM walk)),
down AS (SELECT comid AS start, parent AS pos FROM rest UNION SELECT d.start, r.parent FROM down d JOIN rest r ON r.comid = d.pos),
ring AS (SELECT start AS node FROM down WHERE start = pos),
found AS (SELECT node AS comid, root AS root_comid, CAST(hops AS BIGINT) AS hops FROM walk
          UNION ALL SELECT start, min(pos), CAST(-1 AS BIGINT) FROM down WHERE pos IN (SELECT node FROM ring) GROUP BY start)"""

_PAIRS = """pairs AS (SELECT comid AS node, parent AS anc, 1 AS d FROM link WHERE parent IS NOT NULL AND comid IN (SELECT node FROM walk)
          UNION ALL SELECT p.node, l.parent, p.d + 1 FROM pairs p JOIN link l ON l.comid = p.anc WHERE l.parent IS NOT NULL)"""

SQL = {
    "p1_near": """
WITH p AS (SELECT DISTINCT row_id, lat_gage AS la, CASE WHEN lng_gage > 180 THEN lng_gage - 360 ELSE lng_gage END AS lo FROM gages
           WHERE lat_gage BETWEEN -90 AND 90 AND lng_gage >= -180 AND lng_gage < 360 AND NOT (lat_gage = 0 AND lng_gage = 0)),
     q AS (SELECT *, CAST(floor(la / 0.0091) AS BIGINT) AS b FROM p),
     r AS (SELECT *, unnest([b - 1, b, b + 1]) AS bb FROM q)
SELECT x.row_id AS id_a, y.row_id AS id_b FROM q x JOIN r y ON x.b = y.bb AND x.row_id < y.row_id
WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(y.la - x.la) / 2), 2) + cos(radians(x.la)) * cos(radians(y.la)) * pow(sin(radians(y.lo - x.lo) / 2), 2)))) <= 1000.0""",
    "p3_found": f"WITH {_REFS.strip()} SELECT src_table, row_key, ref_state FROM states WHERE ref_state IS NOT NULL",
    "p3_simple": f"WITH {_OUTLETS} SELECT * FROM whole WHERE ref_state IS NOT NULL",
    "p3_partial": f"WITH {_OUTLETS} SELECT * FROM whole WHERE ref_state IS NOT NULL UNION ALL SELECT * FROM part WHERE ref_state IS NOT NULL",
    "p3_full": f"WITH {_OUTLETS} SELECT * FROM whole WHERE ref_state IS NOT NULL UNION ALL SELECT row_id, 'mixed' FROM part",
    "p3_by_month": f"WITH {_REFS.strip()} SELECT src_table, CAST(date_trunc('month', ref_time) AS DATE) AS period, ref_state, count(*) AS n FROM states WHERE ref_state IS NOT NULL GROUP BY ALL",
    "p4_rules": """WITH r AS (SELECT row_id, daily_q_m3s AS d, target_hourly_m3s AS h, [CAST(x AS DOUBLE) FOR x IN target_hourly_m3s IF x IS NOT NULL AND isfinite(x) AND x >= 0 AND x < 400000] AS ok FROM pretrain_rows),
s AS (SELECT row_id, len(ok) < len(h) AS impossible, d IS NOT NULL AND len(ok) > 0 AND CAST(d AS DOUBLE) <> list_sum(ok) / len(ok) AND (isnan(d) OR abs(CAST(d AS DOUBLE) - list_sum(ok) / len(ok)) >= CAST(0.01 AS DOUBLE) * abs(list_sum(ok) / len(ok))) AS mean_off FROM r)
SELECT row_id, impossible, mean_off FROM s WHERE impossible OR mean_off""",
    "p5_found": f"{_FOUND} SELECT comid, root_comid, hops FROM found",
    "p5_paths": f"""{_TREE},
path AS (SELECT comid AS node, CAST(comid AS VARCHAR) AS p FROM link WHERE parent IS NULL
         UNION ALL SELECT l.comid, l.comid || '>' || w.p FROM path w JOIN link l ON l.parent = w.node)
SELECT l.comid, p AS path FROM link l LEFT JOIN path ON node = l.comid""",
    "p5_upstream": f"{_TREE}, {_PAIRS} SELECT anc AS comid, count(*) AS n_above, max(d) AS farthest FROM pairs GROUP BY anc",
    "p5_descendants": f"{_TREE}, {_PAIRS} SELECT anc AS comid, node AS above, d AS hops FROM pairs",
    "p5_rounds": f"{_FOUND}, {_PAIRS}, up AS (SELECT anc, count(*) AS n FROM pairs GROUP BY anc) SELECT comid, root_comid, hops, CASE WHEN hops >= 0 THEN coalesce(up.n, 0) END AS n_above FROM found LEFT JOIN up ON up.anc = comid",
}
