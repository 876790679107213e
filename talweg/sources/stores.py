"""Gauge lists, statistics, series and graph stores: readers and writers over CSV, JSON and Parquet."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions.common import finite, pad_station

GAUGE_REQUIRED = ["STAID", "DRAIN_SQKM", "LAT_GAGE", "LNG_GAGE"]
GAUGE_TYPES = {"DRAIN_SQKM": "double", "LAT_GAGE": "double", "LNG_GAGE": "double", "COMID": "bigint", "COMID_DRAIN_SQKM": "double", "COMID_UNITAREA_SQKM": "double", "ABS_DIFF": "double", "FLOW_SCALE": "float"}


def parse_flag(c: Column) -> Column:
    """True, true, 1, False, false, 0 or null; anything else is an error at run time."""
    return F.when(c.isNull() | (F.trim(c) == ""), None).when(c.isin("True", "true", "1"), True).when(c.isin("False", "false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("no flag: "), c)).cast("boolean"))


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """A gauge list from a CSV with header, or a folder of them in the order of their names, of each station the first row.

    Required columns must be there; the others become null. A missing name is the station id.
    """
    raw = spark.read.option("header", True).csv(path).withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())
    lost = [c for c in GAUGE_REQUIRED if c not in raw.columns]
    if lost:
        raise ValueError(f"{path} lacks {lost}")
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    out = raw.select(
        pad_station(F.trim("STAID")).alias("staid"), F.coalesce(have("STANAME"), F.col("STAID")).alias("staname"),
        *[have(c).cast(t).alias(c.lower()) for c, t in GAUGE_TYPES.items()], parse_flag(have("DA_VALID")).alias("da_valid"), "_file", "_line",
    )
    w = Window.partitionBy("staid").orderBy("_file", "_line")
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_file", "_line")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(name, min, max, mean, std, p10, p90) from a JSON side file {name: {...}}."""
    stat = "struct<min:double,max:double,mean:double,std:double,p10:double,p90:double>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{stat}>")).alias("name", "s")).select("name", "s.*")


def merge_statistics(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """For each name the first part that has it; a name that none has is an error."""
    rows = [p.withColumn("_i", F.lit(i)) for i, p in enumerate(parts)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    got = both.filter(F.col("name").isin(names)).withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy("_i"))).filter("_rn = 1").drop("_rn", "_i")
    lost = set(names) - {r["name"] for r in got.select("name").collect()}
    if lost:
        raise ValueError(f"no statistics of {sorted(lost)}")
    return got


def time_axis(units: Column) -> Column:
    """(epoch, step) of units such as ``days since 1980-01-01`` or ``hours since 1980-01-01 00:00:00``; anything else is an error at run time."""
    step = F.regexp_extract(units, r"^(days|hours) since (\d{4}-\d{2}-\d{2})", 1)
    day = F.regexp_extract(units, r"^(days|hours) since (\d{4}-\d{2}-\d{2})", 2)
    bad = F.raise_error(F.concat(F.lit("no time axis: "), F.coalesce(units, F.lit("null"))))
    return F.when(step != "", F.struct(day.cast("date").alias("epoch"), step.alias("step"))).otherwise(F.struct(bad.cast("date").alias("epoch"), F.lit("").alias("step")))


def hourly_axis_faults(series: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, ts): places where an hourly axis does not begin at hour 0 or does not step by one hour."""
    before = F.lag(ts).over(Window.partitionBy(by).orderBy(ts))
    bad = F.when(before.isNull(), F.hour(ts) != 0).otherwise(F.col(ts) != before + F.expr("interval 1 hour"))
    return series.select(by, ts, bad.alias("_b")).filter("_b").select(by, ts)


def read_window(series: DataFrame, ids: DataFrame, key: str, ts: str, value: str, first, last, default: float) -> DataFrame:
    """(key, ts, value) for every id and every time of the window that the store has; an id that the store lacks gets ``default``, a null stays.

    A window outside the store is an error, never cut.
    """
    bounds = series.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    if bounds["a"] is None or str(first) < str(bounds["a"]) or str(last) > str(bounds["b"]):
        raise ValueError(f"the store covers {bounds['a']} to {bounds['b']}, not {first} to {last}")
    own = series.filter(F.col(ts).between(first, last)).join(ids, key, "left_semi").select(key, ts, value)
    lost = ids.join(series.select(key).distinct(), key, "left_anti")
    times = series.filter(F.col(ts).between(first, last)).select(ts).distinct().agg(F.collect_list(ts).alias("_t"))
    return own.unionByName(lost.crossJoin(times).select(key, F.explode("_t").alias(ts), F.lit(default).alias(value)))


def series_of_arrays(stores: DataFrame, key: str, values: str, epoch: str = "1980-01-01") -> DataFrame:
    """(key, day, value): one array per gauge read as daily values from the epoch on; NaN becomes null."""
    e = stores.select(key, F.posexplode(values).alias("_i", "value"))
    return e.select(key, F.date_add(F.lit(epoch).cast("date"), F.col("_i")).alias("day"), finite("value").alias("value"))


def state_of_day(states: DataFrame, ids: DataFrame, day: str) -> DataFrame:
    """The state of every id on one day; an id or a day without one is an error at run time."""
    from talweg.operators.relational import strict_gather

    return strict_gather(ids, states.filter(F.col("day") == F.lit(day).cast("date")).drop("day"), "comid")


def read_matrix(spark: SparkSession, path: str, rows: int, columns: int, out: str = "value") -> DataFrame:
    """(row, col, value) of a flat little-endian float32 matrix."""

    def explode(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for blob in b["content"]:
                m = np.frombuffer(bytes(blob), "<f4").reshape(rows, columns)
                for i in range(rows):
                    yield pd.DataFrame({"row": i, "col": np.arange(columns), out: m[i].astype("f8")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(explode, f"row int, col int, {out} double")


def write_graph(reach: DataFrame, edge: DataFrame, path: str) -> None:
    """A graph store: reach(pos, comid, ...) and edge(down, up)."""
    reach.write.mode("overwrite").parquet(f"{path}/reach")
    edge.write.mode("overwrite").parquet(f"{path}/edge")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/reach"), spark.read.parquet(f"{path}/edge")


def graph_faults(reach: DataFrame, edge: DataFrame) -> DataFrame:
    """(fault, n) of a graph store whose reach table has comid, basin and pos: positions that are no run 0..n-1 in a basin, repeated reaches, edges to unknown reaches and edges that do not go to a later position of their basin."""
    p = reach.groupBy("basin").agg((F.count("*") == F.countDistinct("pos")).alias("d"), (F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("r"), (F.min("pos") == 0).alias("z"))
    at = reach.select("comid", "basin", "pos")
    e = edge.join(at.withColumnsRenamed({"comid": "down", "basin": "_b", "pos": "_p"}), "down", "left").join(at.withColumnsRenamed({"comid": "up", "basin": "_c", "pos": "_q"}), "up", "left")
    lost = F.col("_p").isNull() | F.col("_q").isNull()
    rows = [
        p.filter("not (d and r and z)").select(F.lit("positions").alias("fault")),
        reach.groupBy("comid").count().filter("count > 1").select(F.lit("repeated").alias("fault")),
        e.filter(lost).select(F.lit("unknown").alias("fault")),
        e.filter(~lost & ((F.col("_b") != F.col("_c")) | (F.col("_q") >= F.col("_p")))).select(F.lit("order").alias("fault")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("fault").agg(F.count("*").alias("n"))


def open_graph(spark: SparkSession, path: str) -> DataFrame:
    """(basin, row, col, down, up): the edges by position, sorted in each basin; a store whose layout is broken is an error."""
    reach, edge = read_graph(spark, path)
    faults = {r["fault"]: r["n"] for r in graph_faults(reach, edge).collect()}
    if faults:
        raise ValueError(f"{path}: {faults}")
    at = reach.select("comid", "basin", "pos")
    return edge.join(at.select(F.col("comid").alias("down"), "basin", F.col("pos").alias("row")), "down").join(at.select(F.col("comid").alias("up"), F.col("pos").alias("col")), "up").select("basin", "row", "col", "down", "up")


def write_series(series: DataFrame, key: str, ts: str, value: str, units: str, path: str) -> None:
    """A series store: (key, step, value) with the steps counted in ``units`` (days or hours since a date), which stand beside the table."""
    step, epoch = units.split()[0], " ".join(units.split()[2:])
    since = F.datediff(F.col(ts), F.lit(epoch).cast("date")) if step == "days" else F.timestamp_diff("HOUR", F.lit(epoch).cast("timestamp"), F.col(ts).cast("timestamp"))
    series.select(key, since.cast("int").alias("step"), F.col(value).alias("value")).write.mode("overwrite").parquet(f"{path}/series")
    series.sparkSession.createDataFrame([(units, key)], "units string, key string").coalesce(1).write.mode("overwrite").json(f"{path}/units")


def open_series(spark: SparkSession, path: str) -> DataFrame:
    """(key, ts, value, resolution) of a series store: times from its units, days as dates and hours as timestamps without a zone."""
    meta = spark.read.schema("units string, key string").json(f"{path}/units").first()
    axis = spark.range(1).select(time_axis(F.lit(meta["units"])).alias("a")).select("a.*").first()
    epoch = F.lit(axis["epoch"])
    ts = F.date_add(epoch, F.col("step")) if axis["step"] == "days" else (epoch.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("step")))
    return spark.read.parquet(f"{path}/series").select(meta["key"], ts.alias("ts"), "value", F.lit(axis["step"]).alias("resolution"))


def rho_window(daily: DataFrame, key: str, start: str, rho: int, default: float = 0.001, ids: DataFrame | None = None) -> DataFrame:
    """(key, hour, value): the (rho - 1) * 24 hours from ``start`` on, each day's value in each of its hours; ids that the store lacks get ``default``, days without a value null."""
    own = daily.select(key).distinct() if ids is None else ids.select(key).distinct()
    days = own.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(rho - 2)))).withColumn("ts", F.date_add(F.lit(start).cast("date"), F.col("d")))
    known = daily.select(key).distinct().withColumn("_known", F.lit(True))
    got = days.join(daily.select(key, "ts", "value"), [key, "ts"], "left").join(known, key, "left")
    got = got.withColumn("value", F.when(F.col("_known").isNull(), F.lit(default)).otherwise(F.col("value")))
    return got.select(key, F.explode(F.sequence(F.col("d") * 24, F.col("d") * 24 + 23)).alias("hour"), "value")


def write_zoned(series: DataFrame, zone: str, path: str) -> None:
    """A store of several zones, a folder each, so that a reader of some zones reads only theirs."""
    series.repartition(zone).write.mode("overwrite").partitionBy(zone).parquet(path)


def open_zoned(spark: SparkSession, path: str, key: str, ids: DataFrame, zone: str = "zone") -> DataFrame:
    """The rows of ``ids`` (key, zone) from a zoned store: the zones that occur in ``ids`` prune its folders, then the ids are looked up. Ids are unique in their zone only."""
    zones = [r[0] for r in ids.select(zone).distinct().collect()]  # folders of the store
    return spark.read.parquet(path).filter(F.col(zone).isin(zones)).join(ids.select(key, zone).distinct(), [key, zone], "left_semi")


def sniff(path: str) -> str:
    """The kind of a store by its layout on a local or mounted path: graph, units, zoned, arrays, csv, matrix or table."""
    p = Path(path.removeprefix("file://"))
    names = {x.name for x in p.iterdir()} if p.is_dir() else set()
    if p.suffix == ".f32":
        return "matrix"
    if p.suffix == ".csv" or any(n.endswith(".csv") for n in names):
        return "csv"
    if {"reach", "edge"} <= names:
        return "graph"
    if {"series", "units"} <= names:
        return "units"
    return "zoned" if any("=" in n for n in names) else "table"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The table behind a store of any kind."""
    kind = sniff(path)
    if kind == "graph":
        return read_graph(spark, path)[1]
    if kind == "units":
        return open_series(spark, path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "matrix":
        raise ValueError(f"{path}: a matrix needs its shape, use read_matrix")
    return spark.read.parquet(path)


def read_probe_plan(spark: SparkSession, path: str) -> DataFrame:
    """(round, comid, delta) of a probe plan, by the names in the header in any order; a pair of round and comid that occurs twice is an error."""
    raw = spark.read.option("header", True).csv(path)
    lost = {"round", "comid"} - set(raw.columns)
    if lost:
        raise ValueError(f"{path} lacks {sorted(lost)}")
    plan = raw.select(F.col("round").cast("int").alias("round"), F.col("comid").cast("long").alias("comid"), (F.col("delta").cast("double") if "delta" in raw.columns else F.lit(None).cast("double")).alias("delta"))
    twice = plan.groupBy("round", "comid").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{path}: round {twice['round']}, comid {twice['comid']} occurs {twice['count']} times")
    return plan


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a matrix in a CSV without header, whose first column numbers the rows."""
    cells = F.split("value", ",")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim(cells[0]).cast("int").alias("row"), F.posexplode(F.slice(cells, 2, F.size(cells) - 1)).alias("col", "_v")).select("row", "col", F.trim("_v").cast("double").alias("value"))


def write_matrix(cells: DataFrame, rows: int, columns: int, path: str) -> None:
    """(row, col, value) as a flat little-endian float32 matrix with its shape beside it; absent cells are NaN. A row at a time on the driver."""
    import numpy as np

    whole = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m")).orderBy("row")
    at = 0
    with open(path, "wb") as f:
        for r in whole.toLocalIterator():
            np.full((r["row"] - at) * columns, np.nan, "<f4").tofile(f)
            line = np.full(columns, np.nan, "<f4")
            for c, x in r["m"].items():
                line[c] = np.nan if x is None else x
            line.tofile(f)
            at = r["row"] + 1
        np.full((rows - at) * columns, np.nan, "<f4").tofile(f)
    write_json(f"{path}.json", {"rows": rows, "columns": columns})


def write_gauge_edges(edges: DataFrame, path: str) -> None:
    """One partition per gauge, so that a reader of some gauges reads only theirs."""
    edges.repartition("staid").write.mode("overwrite").partitionBy("staid").parquet(path)


def read_gauge_edges(spark: SparkSession, path: str, staids: list[str]) -> DataFrame:
    """The edges of some gauges; gauges that the store lacks are passed over."""
    return spark.read.schema("down bigint, up bigint, staid string").parquet(path).filter(F.col("staid").isin(staids))


def write_padded_series(daily: DataFrame, by: str, day: str, value: str, first: str, path: str) -> None:
    """Daily series from ``first`` on without gaps, null where nothing was read."""
    ends = daily.groupBy(by).agg(F.max(day).alias("_e"))
    axis = ends.select(by, F.explode(F.sequence(F.lit(first).cast("date"), F.col("_e"), F.expr("interval 1 day"))).alias(day))
    axis.join(daily, [by, day], "left").write.mode("overwrite").parquet(path)


def write_json(path: str, value) -> None:
    """A small file, whole or not at all."""
    tmp = f"{path}.tmp"
    Path(tmp).write_text(json.dumps(value, indent=1, sort_keys=True, default=str))
    os.replace(tmp, path)
