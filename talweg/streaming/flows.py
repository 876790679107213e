"""Streams: daily pooling with a watermark, runs of days as sessions, routing with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talweg.functions.recurrence import Network, route
from talweg.operators.parts import Parts, rows_of
from talweg.session import Scratch


def pool_days_stream(hourly: DataFrame, by: str, ts: str, value: str, tau: int = 0, late: str = "2 hours") -> DataFrame:
    """(by, start, value, hours): means over tumbling days that begin ``tau`` hours after midnight; later rows than ``late`` are dropped."""
    w = F.window(ts, "24 hours", "24 hours", f"{tau} hours")
    return hourly.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.avg(value).alias(value), F.count(value).alias("hours")).select(by, F.col("w.start").alias("start"), value, "hours")


def sessions_stream(rows: DataFrame, by: str, ts: str, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """(by, first, last, n): runs of readings with no gap of ``gap`` or more."""
    return rows.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(by, "first", "last", "n")


def route_stream(forcing: DataFrame, network: DataFrame) -> DataFrame:
    """(basin, comid, t, q): routing that goes on where the last batch ended.

    ``forcing``: basin, comid, t, q_lateral, each batch whole hours of whole basins in order; an hour that arrives after a later
    one, or a batch without some reach of its basin, is an error. ``network`` (basin, comid, parent, length_m, slope) is a table
    that the stream is joined with, so a task sees the basins it routes and no more. The state of a basin is its discharge,
    its last lateral inflow and its hour.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        reach = rows.drop_duplicates("comid").sort_values("comid", ignore_index=True)
        ids = pd.Index(reach["comid"])
        net = Network(ids.get_indexer(reach["parent"].fillna(-1).astype("int64")))
        if (state.exists and len(state.get[0]) != len(ids)) or (net.parent < 0).sum() != reach["parent"].isna().sum():
            raise ValueError(f"basin {key[0]}: a batch lacks reaches")
        hours = np.sort(rows["t"].unique())
        m = np.zeros((len(hours), len(ids)))
        np.add.at(m, (np.searchsorted(hours, rows["t"]), ids.get_indexer(rows["comid"])), rows["q_lateral"].to_numpy("f8"))
        params = {"n": 0.05, "q_spatial": 0.5, "p_spatial": 21.0}
        args = (params, reach["length_m"].to_numpy("f8"), reach["slope"].to_numpy("f8"))
        if state.exists:
            q, last, t = state.get
            if hours[0] <= t:
                raise ValueError(f"basin {key[0]}: hour {hours[0]} after hour {t}")
            qs = route(net, np.vstack([np.array(last), m]), *args, start=np.array(q))[1:]
        else:
            qs = route(net, m, *args)
        state.update((qs[-1].value.tolist(), m[-1].tolist(), int(hours[-1])))
        out = np.stack([x.value for x in qs])
        yield pd.DataFrame({"basin": key[0], "comid": np.tile(ids, len(hours)), "t": np.repeat(hours, len(ids)), "q": out.ravel()})

    placed = forcing.join(network.select("basin", "comid", "parent", "length_m", "slope"), ["basin", "comid"])
    return placed.groupBy("basin").applyInPandasWithState(advance, "basin long, comid long, t int, q double", "q array<double>, last array<double>, t int", "append", GroupStateTimeout.NoTimeout)


def route_stream_in_parts(forcing: DataFrame, parts: Parts) -> DataFrame:
    """(comid, hours, r): what ``route_stream`` gives, an array of hours and one of flows for each batch and reach, for basins of any size.

    ``forcing``: comid, t, q_lateral, each batch whole hours of all reaches of ``parts``, in order; an hour that arrives after a
    later one, or a batch without some reach, is an error. The state, the last flow and lateral inflow of every reach, is a table.
    """
    spark, scratch = forcing.sparkSession, Scratch(forcing.sparkSession)
    reaches, seen = sum(parts.sizes.values()), {}

    def advance(batch: DataFrame, number: int) -> None:
        rows = batch.select("comid", "t", "q_lateral").groupBy("comid").agg(F.array_sort(F.collect_list(F.struct("t", "q_lateral"))).alias("_x"))
        lateral = scratch.save(rows.select("comid", F.col("_x.t").alias("hours"), F.col("_x.q_lateral").alias("inflow")), f"in{number}")
        kinds = lateral.groupBy("hours").count().limit(2).collect()
        if not kinds:
            return
        hours = kinds[0]["hours"]
        known = lateral.join(parts.reaches.select("comid"), "comid", "left_semi").count()
        if len(kinds) > 1 or len(set(hours)) < len(hours) or known < reaches:
            raise ValueError(f"batch {number} lacks reaches")
        before = max((n for n in seen if n < number), default=None)
        if before is not None:
            if hours[0] <= seen[before][-1]:
                raise ValueError(f"hour {hours[0]} after hour {seen[before][-1]}")
            lateral = lateral.join(scratch.read(f"state{before}"), "comid").withColumn("inflow", F.concat(F.array("_inflow"), "inflow")).drop("_inflow")
        first = 0 if before is None else 1
        r, last = parts.route(lambda own, a, b: rows_of(own, "inflow").T, first, first + len(hours), state=lateral.drop("hours"), keep_state=True)
        scratch.save(last.join(lateral.select("comid", F.element_at("inflow", -1).alias("_inflow")), "comid"), f"state{number}")
        scratch.save(r.withColumn("hours", F.array(*[F.lit(int(h)) for h in hours])).select("comid", "hours", "r"), f"out{number}")
        seen[number] = hours

    forcing.writeStream.foreachBatch(advance).option("checkpointLocation", scratch.path("log")).trigger(availableNow=True).start().awaitTermination()
    kind = "comid long, hours array<int>, r array<double>"
    return scratch.read(*[f"out{n}" for n in sorted(seen)], schema=kind) if seen else spark.createDataFrame([], kind)


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream gives for what is there now, as a table."""
    scratch = Scratch(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("log")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(scratch.path("out"))
    out = scratch.path("out")
    q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", scratch.path("log")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
