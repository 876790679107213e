"""Queries take all of their input, not a share of it."""

import datetime as dt

import pytest
from conftest import DATA
from talweg.plans import routing_q, scores_q, stores_q
from talweg.plans import views as v


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Two stations with two days each: 3001 days apart, and a long id with days ten apart."""
    d = str(tmp_path_factory.mktemp("records"))
    day = lambda n: dt.date(1985, 1, 1) + dt.timedelta(n)
    rows = [("00000007", day(0), 1.0), ("00000007", day(3000), 2.0), ("12345678", day(0), 3.0), ("12345678", day(9), 4.0)]
    spark.createDataFrame(rows, "staid string, obs_day date, daily_q_m3s float").write.parquet(f"{d}/pretrain_rows.parquet")
    spark.createDataFrame(rows, "gage_id string, obs_day date, streamflow double").write.parquet(f"{d}/daily_obs.parquet")
    return d


def test_t1_long_records(spark, records):
    got = {r["staid"]: (r["count"], r["n"]) for r in scores_q.t1_day_axis(spark, records).groupBy("staid").agg({"*": "count", "obs": "count"}).withColumnsRenamed({"count(1)": "count", "count(obs)": "n"}).collect()}
    assert got == {"00000007": (3001, 2), "12345678": (10, 2)}


def test_k6_every_station_is_written(spark, records):
    first = (dt.date(1985, 1, 1) - dt.date(1980, 1, 1)).days
    got = {r.staid: (r.days, r.read) for r in stores_q.k6_padded_series(spark, records).collect()}
    assert got == {"00000007": (first + 3001, 2), "12345678": (first + 10, 2)}


def test_m10_all_seven_rounds(spark):
    assert {r.variant for r in routing_q.m10_perturbed_outflow(spark, DATA).select("variant").distinct().collect()} == set(range(1, 8))


def test_m5_whole_basins(spark, monkeypatch):
    monkeypatch.setattr(stores_q.mo, "train", lambda groups, *a, **k: ({}, [groups.count(), groups.select("basin").distinct().count()]))
    assert [r.loss for r in stores_q.m5_training_losses(spark, DATA.replace("0.001", "0.01")).orderBy("step").collect()] == [2000, 3]


def test_s7_all_live_reaches(spark):
    a, live = v.attributes(spark, DATA).select("comid"), v.live(spark, DATA).select("comid")
    assert {r.comid for r in stores_q.s7_attributes_present(spark, DATA).collect()} == {r.comid for r in a.intersect(live).collect()}


def test_w3_all_basins(spark):
    got = stores_q.w3_routing_stream(spark, DATA)
    assert got.count() == 12 * v.reach(spark, DATA).count() and got.select("basin").distinct().count() == 3


def test_m9_every_step_counts(spark, monkeypatch):
    whole = {r.comid: r.gradient for r in routing_q.m9_reach_gradients(spark, DATA).collect()}
    monkeypatch.setattr(routing_q, "STEPS", 12)
    assert {r.comid: r.gradient for r in routing_q.m9_reach_gradients(spark, DATA).collect()} != pytest.approx(whole, rel=1e-6)
