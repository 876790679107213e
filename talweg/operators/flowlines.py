"""The reach table as it stands: current rows, live reaches, downstream links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPS = ["up1", "up2", "up3", "up4"]


def reach_status(flowlines: DataFrame) -> DataFrame:
    """One row per comid: the columns of its current row (latest loaded_at, then highest fid), ``first_seen`` and ``is_deleted``.

    A null ``loaded_at`` counts as older than any other. Rows without a comid are left out.
    """
    row = F.struct("loaded_at", "fid", "nextdownid", *UPS, "removed_at")
    return (
        flowlines.filter(F.col("comid").isNotNull())
        .groupBy("comid")
        .agg(F.max(F.struct(F.col("loaded_at").isNotNull().alias("_t"), "loaded_at", "fid", row.alias("row"))).alias("m"), F.min("loaded_at").alias("first_seen"))
        .select("comid", "m.row.*", "first_seen")
        .withColumn("is_deleted", F.col("removed_at").isNotNull())
    )


def downstream_links(flowlines: DataFrame) -> DataFrame:
    """(comid, parent) of every live reach; parent is null where the path ends.

    The parent is ``nextdownid`` of the current row if that is a live reach. Where it is null, it is the smallest live
    reach whose current ``up1``..``up4`` name the reach.
    """
    live = reach_status(flowlines).filter(~F.col("is_deleted")).select("comid", "nextdownid", *UPS)
    named = (
        live.select(F.explode(F.array(*UPS)).alias("_up"), F.col("comid").alias("_by"))
        .filter(F.col("_up") > 0)
        .groupBy("_up")
        .agg(F.min("_by").alias("_by"))
    )
    unknown = F.col("nextdownid").isNull()
    asked = live.select("comid", "nextdownid", F.when(unknown, F.col("comid")).alias("_ask"))
    want = asked.join(named, F.col("_ask") == F.col("_up"), "left").select("comid", F.when(unknown, F.col("_by")).otherwise(F.col("nextdownid")).alias("_want"))
    there = live.select(F.col("comid").alias("parent"))
    return want.join(there, F.col("_want") == F.col("parent"), "left").select("comid", "parent")
