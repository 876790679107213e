import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from talweg.sources import stores
from talweg.sources.fabric import FIELDS, feature_layer, read_fabric

ROWS = [(10, 1.5, 0.01, 20, 0, 0, 0, 0), (20, None, None, 0, 10, 0, 0, 0), (99, 0.0, 0.5, 0, 0, 0, 0, 0)]


def write_dbf(path, rows):
    width = 20
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(FIELDS) + 1, 1 + width * len(FIELDS))
    cols = b"".join(n.encode().ljust(11, b"\x00") + b"N" + b"\x00" * 4 + bytes([width]) + b"\x00" * 15 for n, _, _ in FIELDS)
    body = b"".join(b" " + b"".join(("" if x is None else str(x)).rjust(width).encode() for x in r) for r in rows)
    path.write_bytes(head + cols + b"\x0d" + body + b"\x1a")


def write_gpkg(path, rows, layers=("rivers",)):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        for layer in layers:
            c.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (layer,))
            c.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, ' + ", ".join(f'"{n}" REAL' for n, _, _ in FIELDS) + ")")
            c.executemany(f'INSERT INTO "{layer}" VALUES (NULL, NULL, ?, ?, ?, ?, ?, ?, ?, ?)', rows)


def test_dbf_and_gpkg_read_the_same(spark, tmp_path):
    write_dbf(tmp_path / "a.dbf", ROWS)
    write_gpkg(tmp_path / "a.gpkg", ROWS)
    for name in ("a.dbf", "a.shp", "a.gpkg"):
        got = read_fabric(spark, str(tmp_path / name)).orderBy("comid").collect()
        assert [tuple(r) for r in got] == ROWS
    with pytest.raises(ValueError):
        read_fabric(spark, "x.nc")


def test_layers_and_null_ids(spark, tmp_path):
    write_gpkg(tmp_path / "two.gpkg", ROWS, ("a", "b"))
    with pytest.raises(ValueError):
        feature_layer(str(tmp_path / "two.gpkg"))
    assert read_fabric(spark, str(tmp_path / "two.gpkg"), "b").count() == 3
    write_dbf(tmp_path / "bad.dbf", [(None, 1.0, 0.1, 0, 0, 0, 0, 0)])
    with pytest.raises(Exception, match="COMID is null"):
        read_fabric(spark, str(tmp_path / "bad.dbf")).collect()


def test_gauge_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STAID,STANAME,DRAIN_SQKM,LAT_GAGE,LNG_GAGE,DA_VALID\n1563500,Mapleton,10.5,40.1,-77.9,True\n123456789,,3,1,2,\n")
    (tmp_path / "b.csv").write_text("STAID,STANAME,DRAIN_SQKM,LAT_GAGE,LNG_GAGE,DA_VALID\n01563500,Again,99,0,0,0\n7,Seven,1,1,1,false\n")
    got = {r.staid: (r.staname, r.drain_sqkm, r.da_valid, r.comid) for r in stores.read_gauges(spark, str(tmp_path)).collect()}
    assert got == {"01563500": ("Mapleton", 10.5, True, None), "123456789": ("123456789", 3.0, None, None), "00000007": ("Seven", 1.0, False, None)}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.csv").write_text("STAID,DRAIN_SQKM,LAT_GAGE,LNG_GAGE,DA_VALID\n1,1,1,1,maybe\n")
    with pytest.raises(Exception, match="no flag"):
        stores.read_gauges(spark, str(tmp_path / "bad")).collect()


def test_statistics(spark, tmp_path):
    for n, names in (("a", ["x", "y"]), ("b", ["y", "z"])):
        (tmp_path / f"{n}.json").write_text(json.dumps({k: {"min": 0, "max": 1, "mean": ord(n), "std": 1, "p10": 0, "p90": 1} for k in names}))
    parts = [stores.read_statistics(spark, str(tmp_path / f"{n}.json")) for n in "ab"]
    assert {r["name"]: r["mean"] for r in stores.merge_statistics(parts, ["y", "z"]).collect()} == {"y": ord("a"), "z": ord("b")}
    with pytest.raises(ValueError):
        stores.merge_statistics(parts, ["w"])


def test_axes_and_windows(spark):
    u = spark.createDataFrame([("days since 1981-01-01",), ("hours since 1956-12-07 09:00",)], "u string").select(stores.time_axis(F.col("u")).alias("a")).select("a.*").collect()
    assert [(str(r.epoch), r.step) for r in u] == [("1981-01-01", "days"), ("1956-12-07", "hours")]
    with pytest.raises(Exception, match="no time axis"):
        spark.createDataFrame([("minutes since 1981-01-01",)], "u string").select(stores.time_axis(F.col("u")).alias("a")).collect()
    s = spark.createDataFrame([(j, f"1981-01-{t + 1:02}", float(j * 100 + t) if (j, t) != (2, 3) else None) for j in (1, 2, 3) for t in range(10)], "id long, day string, v double").withColumn("day", F.col("day").cast("date"))
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    got = {(r.id, r.day.day): r.v for r in stores.read_window(s, ids, "id", "day", "v", "1981-01-02", "1981-01-05", 0.001).collect()}
    assert len(got) == 12 and got[1, 2] == 101.0 and got[2, 4] is None and got[9, 5] == 0.001
    with pytest.raises(ValueError):
        stores.read_window(s, ids, "id", "day", "v", "1980-12-31", "1981-01-05", 0.001)
    h = spark.sql("SELECT 1 AS id, explode(array(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 01:00:00', timestamp_ntz'2024-01-01 03:00:00')) AS ts UNION ALL SELECT 2, timestamp_ntz'2024-01-01 05:00:00'")
    assert {(r.id, r.ts.hour) for r in stores.hourly_axis_faults(h, "id", "ts").collect()} == {(1, 3), (2, 5)}
    a = spark.createDataFrame([("A1", [0.0, float("nan"), 2.0])], "g string, x array<double>")
    assert [(str(r.day), r.value) for r in stores.series_of_arrays(a, "g", "x").orderBy("day").collect()] == [("1980-01-01", 0.0), ("1980-01-02", None), ("1980-01-03", 2.0)]


def test_stores_round_trip(spark, tmp_path):
    reach = spark.createDataFrame([(0, 10), (1, 20)], "pos int, comid long")
    edge = spark.createDataFrame([(20, 10)], "down long, up long")
    stores.write_graph(reach, edge, str(tmp_path / "g"))
    r, e = stores.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, r.collect())) == [(0, 10), (1, 20)] and [tuple(x) for x in e.collect()] == [(20, 10)]
    ge = spark.createDataFrame([("01", 20, 10), ("02", 5, 4)], "staid string, down long, up long")
    stores.write_gauge_edges(ge, str(tmp_path / "ge"))
    got = stores.read_gauge_edges(spark, str(tmp_path / "ge"), ["02", "nowhere"])
    assert [tuple(x) for x in got.select("staid", "down", "up").collect()] == [("02", 5, 4)]
    d = spark.createDataFrame([("a", "1981-01-02", 1.0), ("a", "1981-01-04", 2.0)], "g string, day string, v double").withColumn("day", F.col("day").cast("date"))
    stores.write_padded_series(d, "g", "day", "v", "1981-01-01", str(tmp_path / "s"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "s")).orderBy("day").collect()] == [None, 1.0, None, 2.0]
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    m.tofile(tmp_path / "m.f32")
    assert {(r.row, r.col): r.value for r in stores.read_matrix(spark, str(tmp_path / "m.f32"), 2, 3).collect()} == {(i, j): float(m[i, j]) for i in range(2) for j in range(3)}
    s = spark.createDataFrame([(1, "1981-01-01", 3.0)], "comid long, day string, q double").withColumn("day", F.col("day").cast("date"))
    one = spark.createDataFrame([(1,)], "comid long")
    assert stores.state_of_day(s, one, "1981-01-01").first().q == 3.0
    with pytest.raises(Exception, match="no value"):
        stores.state_of_day(s, one, "1981-01-02").collect()
