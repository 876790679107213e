"""Routing in sub-basins gives what routing whole basins gives, and no sub-basin is larger than a task allows."""

import pytest
from conftest import DATA
from talweg.operators import parts as pt
from talweg.plans import engine_q, routing_q, stores_q, views

CUT = 20


def _rows(df):
    names = [c for c, t in df.dtypes if t != "double"]
    return {tuple(r[c] for c in names): [float("nan") if r[c] is None else r[c] for c, t in df.dtypes if t == "double"] for r in df.collect()}


@pytest.fixture()
def cut(monkeypatch):
    """Sub-basins of 20 reaches at most, seven or so together."""

    def go():
        monkeypatch.setattr(pt, "PART_REACHES", CUT)
        monkeypatch.setattr(routing_q, "TAPED", CUT)

    return go


def _both(query, spark, cut):
    whole = _rows(query(spark, DATA))
    cut()
    got = _rows(query(spark, DATA))
    assert got.keys() == whole.keys() and len(got) > 0
    for k, v in whole.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9, nan_ok=True)


def test_sub_basins_are_bounded(spark, cut):
    cut()
    parts = routing_q._parts(spark, DATA)
    assert len(parts.sizes) > 1 and max(r["count"] for r in parts.reaches.groupBy("band", "part").count().collect()) <= CUT


def test_a_loop_is_an_error(spark):
    reach = spark.createDataFrame([(1, 2, 1.0, 0.1), (2, 1, 1.0, 0.1), (3, None, 1.0, 0.1)], "comid long, parent long, length_m double, slope double")
    with pytest.raises(ValueError, match="loop"):
        pt.Parts(reach)


def test_r21_evaluation(spark, cut):
    _both(engine_q.r21_evaluation, spark, cut)


def test_m14_grid(spark, cut):
    _both(engine_q.m14_grid, spark, cut)


def test_m9_reach_gradients(spark, cut):
    _both(routing_q.m9_reach_gradients, spark, cut)


def test_w3_routing_stream(spark, cut):
    _both(stores_q.w3_routing_stream, spark, cut)


def test_w3_stream_agrees(spark, cut):
    _both(engine_q.w3_stream_agrees, spark, cut)


def test_r16_first_hour(spark, cut):
    _both(engine_q.r16_first_hour, spark, cut)


def test_r22_frozen_day(spark, cut):
    _both(routing_q.r22_frozen_day, spark, cut)


def test_m11_teacher(spark, cut):
    _both(routing_q.m11_teacher, spark, cut)


def test_m14_landscape(spark, cut):
    _both(routing_q.m14_landscape, spark, cut)


def test_m12_residual_floor(spark, cut):
    _both(routing_q.m12_residual_floor, spark, cut)


def test_m15_slope_of_roughness(spark, cut):
    _both(routing_q.m15_slope_of_roughness, spark, cut)


def test_r16_gauge_hydrographs(spark, cut):
    _both(routing_q.r16_gauge_hydrographs, spark, cut)


def test_r21_evaluated_days(spark, cut):
    _both(engine_q.r21_evaluated_days, spark, cut)


def _runs(query, spark, cut, monkeypatch):
    """The parts that a query routes, cut, and what leaves the tasks run by run: (comid, r) as a dict."""
    seen, route = [], pt.Parts.route

    def noted(self, *args, **options):
        out = route(self, *args, **options)
        seen.append((self, out[0]))
        return out

    monkeypatch.setattr(pt.Parts, "route", noted)
    cut()
    query(spark, DATA).collect()
    for parts, _ in seen:
        assert len(parts.sizes) > 1 and max(r["count"] for r in parts.reaches.groupBy("band", "part").count().collect()) <= CUT
    return [(parts, {r["comid"]: r["r"] for r in flow.collect()}) for parts, flow in seen]


def _gauged(spark):
    return {r["comid"] for r in views.gauge(spark, DATA).join(views.reach(spark, DATA), "comid", "left_semi").collect()}


def test_r16_gauge_hydrographs_of_gauges_only(spark, cut, monkeypatch):
    """sub-basins go to the tasks, and the hours of the gauges' reaches leave them, no others."""
    [(_, flow)] = _runs(routing_q.r16_gauge_hydrographs, spark, cut, monkeypatch)
    assert flow.keys() == _gauged(spark) and {len(x) for x in flow.values()} == {routing_q.STEPS}


def test_r21_evaluated_days_leave_as_days(spark, cut, monkeypatch):
    """inflow goes to the tasks as days, and sums over the days of the gauges' reaches leave them, chunk by chunk."""
    seen = _runs(engine_q.r21_evaluated_days, spark, cut, monkeypatch)
    assert len(seen) == 2 and sum(len(next(iter(flow.values()))) for _, flow in seen) == engine_q.DAYS
    for parts, flow in seen:
        assert flow.keys() == _gauged(spark) and {len(x) for x in flow.values()} == {10}
        assert 0 < max(len(r["days"] or []) for r in parts.reaches.select("days").collect()) <= engine_q.DAYS


def test_r12_bands_agree(spark, cut):
    _both(engine_q.r12_bands_agree, spark, cut)


def test_r22_days_agree(spark, cut):
    _both(engine_q.r22_days_agree, spark, cut)


def test_t16_chunks_agree(spark, cut):
    _both(engine_q.t16_chunks_agree, spark, cut)


def test_m10_perturbed_outflow(spark, cut):
    _both(routing_q.m10_perturbed_outflow, spark, cut)
