"""Queries p2, p6, p7, p8 and p9 over the project's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.common import finite, station_id
from talweg.llm.keyword_pages import keyword_pages, page_scores
from talweg.llm.leakage import leaks
from talweg.llm.mixture import mixture
from talweg.llm.percentiles import bin_counts, group_percentiles, percentiles_of_bins
from talweg.llm.splits import assign_splits, balance, components, divided, split_name, with_entity
from talweg.sources.tables import table

OFF = 0.08
SAME = ("renumbered", "moved", "same_site", "merged")
SHARES = {"train": 0.7, "val": 0.1, "test": 0.2}


def _zone_values(spark: SparkSession, folder: str) -> DataFrame:
    """(zone_id, attr, value) of the latest row of each comid: aridity and meanP, neither null nor infinite nor negative."""
    rows = table(spark, folder, "reach_attributes").select("comid", "loaded_at", "zone_id", "aridity", "meanp")
    last = rows.groupBy("comid").agg(F.max(F.struct(F.col("loaded_at"), "zone_id", "aridity", "meanp")).alias("m")).select("m.*")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("attr"), finite(c).alias("value")) for n, c in (("aridity", "aridity"), ("meanP", "meanp"))])).alias("s")
    return last.select("zone_id", "loaded_at", each).select("zone_id", "loaded_at", "s.attr", "s.value").filter("value >= 0")


def _ratios(spark: SparkSession, folder: str) -> DataFrame:
    """(station, day, ratio) of daily_q_m3s to streamflow, each day once, where both are finite and above 0."""
    q = table(spark, folder, "pretrain_rows").select(station_id("staid").alias("station"), F.col("obs_day").alias("day"), "delivered_at", finite("daily_q_m3s").alias("q")).filter("q > 0")
    q = q.groupBy("station", "day").agg(F.max(F.struct("delivered_at", "q")).alias("m")).select("station", "day", F.col("m.q").alias("q"))
    o = table(spark, folder, "daily_obs").select(station_id("gage_id").alias("station"), F.col("obs_day").alias("day"), finite("streamflow").alias("o")).filter("o > 0").groupBy("station", "day").agg(F.max("o").alias("o"))
    return q.join(o, ["station", "day"]).select("station", "day", (F.col("q") / F.col("o")).alias("ratio"))


def p2_zone_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact p10 and p90 of aridity and meanP of every zone."""
    got = group_percentiles(_zone_values(spark, folder), ["zone_id", "attr"], "value", [0.1, 0.9])
    return got.select("zone_id", "attr", "n", F.col("quantiles")[0].alias("p10"), F.col("quantiles")[1].alias("p90"))


def p2_station_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median ratio of every station."""
    got = group_percentiles(_ratios(spark, folder), ["station"], "ratio", [0.5])
    return got.select(F.col("station").alias("staid"), "n", F.col("quantiles")[0].alias("median_ratio"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Published percentiles and ratios that are more than 8 % off."""
    zones = _zone_values(spark, folder).select(F.lit("attribute_stats").alias("src_table"), F.col("zone_id").alias("group_key"), "attr", "value")
    ratios = _ratios(spark, folder).select(F.lit("reconciliation").alias("src_table"), F.col("station").alias("group_key"), F.lit("median_ratio").alias("attr"), F.col("ratio").alias("value"))
    true = group_percentiles(zones.unionByName(ratios), ["src_table", "group_key", "attr"], "value", [0.1, 0.5, 0.9])
    stats = table(spark, folder, "attribute_stats").filter(F.col("attr_name").isin("aridity", "meanP"))
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("published")) for p in ("p10", "p90")])).alias("s")
    said = stats.select(F.lit("attribute_stats").alias("src_table"), F.col("zone_id").alias("group_key"), F.col("attr_name").alias("attr"), pairs).select("src_table", "group_key", "attr", "s.p", "s.published")
    rec = table(spark, folder, "reconciliation").select(F.lit("reconciliation").alias("src_table"), station_id("staid").alias("group_key"), F.lit("median_ratio").alias("attr"), F.lit("p50").alias("p"), F.col("median_ratio").cast("double").alias("published"))
    q = F.col("quantiles")
    truth = F.when(F.col("p") == "p10", q[0]).when(F.col("p") == "p50", q[1]).otherwise(q[2])
    off = said.unionByName(rec).filter(F.col("published").isNotNull()).join(true, ["src_table", "group_key", "attr"]).filter(F.abs(F.col("published") - truth) > OFF * F.abs(truth))
    metric = F.when(F.col("p") == "p50", F.col("attr")).otherwise(F.concat_ws(".", "attr", "p"))
    return off.select("src_table", "group_key", metric.alias("metric")).distinct()


def p2_combined(spark: SparkSession, folder: str) -> DataFrame:
    """The zones' percentiles within 1 %, from summaries made per month of load and then added up."""
    rows = _zone_values(spark, folder).withColumn("month", F.date_trunc("month", "loaded_at"))
    months = bin_counts(rows, ["zone_id", "attr", "month"], "value")
    got = percentiles_of_bins(months, ["zone_id", "attr"], [0.1, 0.9])
    return got.select("zone_id", "attr", "n", F.col("quantiles")[0].alias("p10"), F.col("quantiles")[1].alias("p90"))


def p2_within(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the combined percentiles are within 1 % of the exact ones."""
    a, b = p2_combined(spark, folder), p2_zone_percentiles(spark, folder).withColumnsRenamed({"n": "_n", "p10": "_10", "p90": "_90"})
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.01 * F.abs(F.col(y)) + 1e-12
    return a.join(b, ["zone_id", "attr"], "full").select("zone_id", "attr", "n", F.coalesce((F.col("n") == F.col("_n")) & near("p10", "_10") & near("p90", "_90"), F.lit(False)).alias("kept"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "station_links").filter(F.lower(F.trim("link_kind")).isin(*SAME))
    return components(links.select(station_id("staid_a").alias("a"), station_id("staid_b").alias("b")), "a", "b")


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of every linked station."""
    return _entities(spark, folder).select(F.col("entity").alias("staid"), F.col("label").alias("entity"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that a published manifest divides."""
    entries = table(spark, folder, "split_manifest").select("seed", station_id("staid").alias("station"), split_name("split_name").alias("split"))
    return divided(with_entity(entries, "station", _entities(spark, folder)), "entity", "split", ["seed"])


def _stations(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's stations with their entity and the class of their drainage area."""
    named = table(spark, folder, "split_manifest").select(station_id("staid").alias("station")).filter("station is not null").distinct()
    area = table(spark, folder, "gages").select(station_id("staid").alias("station"), "drain_sqkm").groupBy("station").agg(F.max("drain_sqkm").alias("a"))
    size = F.when(F.col("a") < 100, "small").when(F.col("a") < 1000, "middle").when(F.col("a") >= 1000, "large").otherwise("unknown")
    return with_entity(named.join(area, "station", "left").select("station", size.alias("area")), "station", _entities(spark, folder))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A split of the stations that divides no entity: 70 % train, 10 % val, 20 % test of every class of drainage area."""
    stations = _stations(spark, folder)
    return stations.join(assign_splits(stations, "entity", "area", SHARES), "entity").select(F.col("station").alias("staid"), "entity", "split")


def p6_balance(spark: SparkSession, folder: str) -> DataFrame:
    """What shares that split reaches."""
    stations = _stations(spark, folder)
    return balance(stations.join(assign_splits(stations, "entity", "area", SHARES), "entity"), "area", "split")


def _within(spark: SparkSession, folder: str, **options) -> DataFrame:
    stations = _stations(spark, folder)
    largest = stations.groupBy("entity").agg(F.count("*").alias("n")).agg(F.max("n").alias("_most"))
    got = stations.join(assign_splits(stations, "entity", "area", SHARES, **options), "entity").groupBy("area", "split").agg(F.count("*").alias("n"))
    goal = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])
    total = stations.groupBy("area").agg(F.count("*").alias("_all")).withColumn("split", F.explode(F.array(*[F.lit(s) for s in SHARES])))
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("_all") * goal[F.col("split")])
    return total.join(got, ["area", "split"], "left").crossJoin(F.broadcast(largest)).select("area", "split", (off <= F.col("_most")).alias("kept"))


def p6_within(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each split has its share of each class, but for the stations of the largest entity."""
    return _within(spark, folder)


def p6_within_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same with small batches placed side by side."""
    return _within(spark, folder, batch_rows=50)


def p6_entities_salted(spark: SparkSession, folder: str) -> DataFrame:
    """p6_entities by salted joins alone, as beyond the size that is broadcast."""
    links = table(spark, folder, "station_links").filter(F.lower(F.trim("link_kind")).isin(*SAME))
    got = components(links.select(station_id("staid_a").alias("a"), station_id("staid_b").alias("b")), "a", "b", limit_rows=0)
    return got.select(F.col("entity").alias("staid"), F.col("label").alias("entity"))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a leaked passage, the share of its words and where it stands in the original text."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of document and leaked item."""
    return p7_spans(spark, folder).select("doc_id", "item_id")


def p7_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found with ten items to an automaton."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage", block_items=10).select("doc_id", "item_id")


def p7_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of document and item whose question stands in the text, whole if it has under ten words. Generic questions prove no leak by themselves."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "question", short=True).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """The test items that leaked: in how many documents, and the largest share of the passage in one."""
    return p7_spans(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("largest"))


def _mixture(spark: SparkSession, folder: str, of_corpus: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources that may be repeated come late: from half their weight on they stay level, then double in the last third; the others the other way round."""
    targets = table(spark, folder, "source_targets")
    late, early = ((0.0, 0.5), (0.4, 0.5), (0.7, 1.0), (1.0, 2.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
    points = lambda p: F.array(*[F.struct(F.lit(t).alias("time"), F.lit(w).alias("weight")) for t, w in p])
    schedule = targets.select("source", F.explode(F.when(F.col("max_repeats") > 1, points(late)).otherwise(points(early))).alias("p")).select("source", "p.*")
    return mixture(table(spark, folder, "documents"), "doc_id", "source", "text", targets, schedule=schedule, of_corpus=of_corpus)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture in order of training."""
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached."""
    return _mixture(spark, folder)[1]


def p8_whole_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached in a mixture as large as all sources together, in which small sources run out."""
    return _mixture(spark, folder, of_corpus=1.0)[1]


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source keeps its repeats and, if it does not run out, its share within half a document or 1 %."""
    r = _mixture(spark, folder, of_corpus=1.0)[1].filter("source_tokens > 0")
    whole = r.agg(F.sum("tokens").alias("_t"), F.sum("target_share").alias("_s"), F.sum("source_tokens").alias("_c"))
    want = F.least(F.col("_c") * F.col("target_share") / F.col("_s"), F.col("source_tokens") * F.col("max_repeats"))
    ok = (F.col("repeats") <= F.col("max_repeats")) & (F.abs(F.col("tokens") - want) <= F.greatest(want * 0.01, F.lit(2000.0)))
    return r.crossJoin(whole).select("source", ok.alias("kept"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of every page."""
    return page_scores(table(spark, folder, "documents"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword lists, link lists, menus and product tags."""
    return keyword_pages(p9_scores(spark, folder)).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_zone_percentiles, p2_station_medians, p2_combined, p2_within, p6_found, p6_entities, p6_entities_salted, p6_splits, p6_balance, p6_within, p6_within_batches, p7_found, p7_spans, p7_blocks, p7_questions, p7_items, p8_mixture, p8_shares, p8_whole_corpus, p8_limits, p9_found, p9_scores)}

_PAD = "CASE WHEN length({0}) < 8 THEN lpad({0}, 8, '0') ELSE {0} END"


def _station(c: str) -> str:
    bare = f"regexp_replace(trim({c}), '^[A-Za-z]+(-|:|_+)', '')"
    return _PAD.format(bare)


_ZONES = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comid ORDER BY loaded_at DESC, zone_id DESC) AS rn FROM reach_attributes) WHERE rn = 1),
zv AS (SELECT zone_id, 'aridity' AS attr, aridity AS value FROM latest UNION ALL SELECT zone_id, 'meanP', meanp FROM latest),
zp AS (SELECT zone_id, attr, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM zv WHERE isfinite(value) AND value >= 0 GROUP BY ALL)"""
_MEDIANS = f"""q AS (SELECT {_station('staid')} AS s, obs_day AS d, arg_max(CAST(daily_q_m3s AS DOUBLE), delivered_at) AS q FROM pretrain_rows WHERE isfinite(daily_q_m3s) AND daily_q_m3s > 0 GROUP BY ALL),
o AS (SELECT {_station('gage_id')} AS s, obs_day AS d, max(streamflow) AS o FROM daily_obs WHERE isfinite(streamflow) AND streamflow > 0 GROUP BY ALL),
rm AS (SELECT s AS staid, count(*) AS n, quantile_cont(q / o, 0.5) AS median_ratio FROM q JOIN o USING (s, d) GROUP BY ALL)"""
_COMPONENTS = f"""e AS (SELECT {_station('staid_a')} AS a, {_station('staid_b')} AS b FROM station_links WHERE lower(trim(link_kind)) IN ('renumbered', 'moved', 'same_site', 'merged')),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, w.b FROM reach r JOIN both_ways w ON w.a = r.y),
ent AS (SELECT x AS staid, min(y) AS entity FROM reach GROUP BY x)"""

_KEPT = f"""WITH g AS (SELECT {_station('staid')} AS s, max(drain_sqkm) AS a FROM gages GROUP BY 1),
m AS (SELECT DISTINCT {_station('staid')} AS s FROM split_manifest)
SELECT DISTINCT CASE WHEN a < 100 THEN 'small' WHEN a < 1000 THEN 'middle' WHEN a >= 1000 THEN 'large' ELSE 'unknown' END AS area, sp.split, true AS kept
FROM m LEFT JOIN g USING (s) CROSS JOIN (VALUES ('train'), ('val'), ('test')) sp(split) WHERE s IS NOT NULL AND s <> ''"""

SQL = {
    "p2_zone_percentiles": f"WITH {_ZONES} SELECT zone_id, attr, n, p10, p90 FROM zp",
    "p2_station_medians": f"WITH {_MEDIANS} SELECT staid, n, median_ratio FROM rm",
    "p2_found": f"""WITH {_ZONES}, {_MEDIANS}
SELECT DISTINCT 'attribute_stats' AS src_table, s.zone_id AS group_key, s.attr_name || '.' || m.p AS metric
FROM attribute_stats s JOIN zp ON zp.zone_id = s.zone_id AND zp.attr = s.attr_name CROSS JOIN (VALUES ('p10'), ('p90')) m(p)
WHERE abs(CASE m.p WHEN 'p10' THEN s.p10 ELSE s.p90 END - CASE m.p WHEN 'p10' THEN zp.p10 ELSE zp.p90 END) > CAST(0.08 AS DOUBLE) * CASE m.p WHEN 'p10' THEN zp.p10 ELSE zp.p90 END
UNION ALL SELECT DISTINCT 'reconciliation', rm.staid, 'median_ratio' FROM reconciliation r JOIN rm ON rm.staid = {_station('r.staid')}
WHERE abs(CAST(r.median_ratio AS DOUBLE) - rm.median_ratio) > CAST(0.08 AS DOUBLE) * rm.median_ratio""",
    "p6_entities": f"WITH RECURSIVE {_COMPONENTS} SELECT staid, entity FROM ent",
    "p6_entities_salted": f"WITH RECURSIVE {_COMPONENTS} SELECT staid, entity FROM ent",
    "p6_within": _KEPT,
    "p6_within_batches": _KEPT,
    "p8_limits": "SELECT DISTINCT t.source, true AS kept FROM (SELECT lower(trim(source)) AS source FROM source_targets WHERE target_share > 0) t WHERE t.source IN (SELECT lower(trim(source)) FROM documents WHERE text <> '')",
    "p2_within": f"WITH {_ZONES} SELECT zone_id, attr, n, true AS kept FROM zp",
    "p6_found": f"""WITH RECURSIVE {_COMPONENTS},
m AS (SELECT seed, {_station('staid')} AS s, CASE substr(lower(trim(split_name)), 1, 2) WHEN 'tr' THEN 'train' WHEN 'va' THEN 'val' WHEN 'te' THEN 'test' END AS sp FROM split_manifest)
SELECT seed, coalesce(ent.entity, m.s) AS entity FROM m LEFT JOIN ent ON ent.staid = m.s GROUP BY ALL HAVING count(DISTINCT sp) > 1""",
}
