import numpy as np
import pytest
from pyspark.sql import functions as F
from talweg.functions import physics as ph
from talweg.functions.recurrence import Network, route, step
from talweg.functions.tape import Var
from talweg.operators import routing as ro
from talweg.operators.hierarchy import hierarchy

RNG = np.random.default_rng(3)


def tree(n):
    parent = np.array([-1] + [int(RNG.integers(max(0, i - 4), i)) for i in range(1, n)])
    return parent, RNG.uniform(300, 9000, n), RNG.uniform(1e-3, 0.03, n)


PARAMS = {"n": 0.05, "q_spatial": 0.5, "p_spatial": 21.0}


def test_coefficients_and_solve():
    parent, length, slope = tree(60)
    net = Network(parent)
    c1, b = RNG.uniform(-0.3, 0.9, 60), RNG.normal(size=60)
    dense = np.eye(60)
    for i, p in enumerate(parent):
        if p >= 0:
            dense[p, i] = -c1[p]
    assert net.solve(c1, b) == pytest.approx(np.linalg.solve(dense, b), abs=1e-12)
    assert net.solve_adjoint(c1, b) == pytest.approx(np.linalg.solve(dense.T, b), abs=1e-12)
    assert Network(np.array([-1, 0, 1, 2])).accumulate(np.ones(4)) == pytest.approx([4, 3, 2, 1])
    with pytest.raises(ValueError):
        Network(np.array([1, 0]))


@pytest.mark.parametrize("legacy", [False, True])
def test_adjoint_against_finite_differences(legacy):
    parent, length, slope = tree(12)
    net = Network(parent)
    lateral = RNG.uniform(0.5, 3, (6, 12))
    weights = RNG.normal(size=12)

    def loss(n, p):
        qs = route(net, lateral, {"n": n, "q_spatial": Var(np.full(12, 0.4)), "p_spatial": p}, length, slope, legacy=legacy)
        total = Var(0.0)
        for q in qs[1:]:
            total = total + (q * weights).sum()
        return total

    n0, p0 = RNG.uniform(0.03, 0.1, 12), RNG.uniform(5, 40, 12)
    n, p = Var(n0), Var(p0)
    loss(n, p).backward()
    for var, base, make in ((n, n0, lambda x: loss(Var(x), Var(p0))), (p, p0, lambda x: loss(Var(n0), Var(x)))):
        for i in (0, 5, 11):
            h = 1e-6 * base[i]
            up, down = base.copy(), base.copy()
            up[i] += h
            down[i] -= h
            assert var.grad[i] == pytest.approx(float(make(up).value - make(down).value) / (2 * h), rel=2e-4, abs=1e-8)


def test_positivity_and_mass():
    parent, length, slope = tree(40)
    net, seen = Network(parent), []
    lateral = np.full((200, 40), 0.7)
    qs = route(net, lateral, PARAMS, length, slope, start=np.full(40, 1e-4), diagnostics=seen)
    assert sum(s["negative"] for s in seen) == 0
    assert qs[-1].value[0] == pytest.approx(0.7 * 40, rel=1e-3)
    assert all((s["c1"] >= 0).all() and (s["c3"] >= 0).all() for s in seen)


def test_chunks_with_carried_state_equal_one_run():
    parent, length, slope = tree(30)
    net, lateral = Network(parent), RNG.uniform(0.1, 2, (24, 30))
    whole = route(net, lateral, PARAMS, length, slope)
    first = route(net, lateral[:13], PARAMS, length, slope)
    second = route(net, lateral[12:], PARAMS, length, slope, start=first[-1].value)
    assert np.stack([q.value for q in first + second[1:]]) == pytest.approx(np.stack([q.value for q in whole]), abs=0)


def test_leakance_by_hand(spark):
    df = spark.range(1).select(ph.leakance(F.lit(2.0), F.lit(10.0), F.lit(0.5), F.lit(1000.0), F.lit(1e-6), F.lit(1.0), F.lit(0.5)).alias("z"), ph.leakance(F.lit(1.0), F.lit(10.0), F.lit(0.5), F.lit(1000.0), F.lit(1e-6), F.lit(3.0), F.lit(1.0), losing_only=False).alias("g"), ph.leakance(F.lit(1.0), F.lit(10.0), F.lit(0.5), F.lit(1000.0), F.lit(1e-6), F.lit(3.0), F.lit(1.0)).alias("c"))
    r = df.first()
    assert r.z == pytest.approx(0.002236068, rel=1e-4)
    assert r.g < 0 and r.c == 0


def test_columns_closed_form_and_bands_agree_with_numpy(spark):
    parent, length, slope = tree(50)
    net = Network(parent)
    rows = [(i, int(p) if p >= 0 else None, float(length[i]), float(slope[i])) for i, p in enumerate(parent)]
    reach = spark.createDataFrame(rows, "comid long, parent long, length_m double, slope double")
    paths = hierarchy(reach, "comid", "parent", with_paths=True)
    q = RNG.uniform(0.5, 5, 50)
    qd = spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "comid long, q double")
    c = reach.join(qd, "comid").withColumns({k: F.lit(x) for k, x in ph.FROZEN.items()})
    c = ph.with_muskingum(ph.with_celerity(ph.with_geometry(c)))
    assert c.filter(F.abs(F.col("c1") + F.col("c2") + F.col("c3") - 1) > 1e-12).count() == 0
    up = c.filter("parent is not null").groupBy(F.col("parent").alias("comid")).agg(F.sum("q").alias("i"))
    b = c.join(up, "comid", "left").select("comid", (F.col("c2") * F.coalesce("i", F.lit(0.0)) + F.col("c3") * F.col("q") + F.col("c4") * 0.3).alias("b"), "c1")
    got = {r.comid: r.x for r in ro.one_step_closed_form(reach, b).collect()}
    want = step(net, Var(q), 0.3, PARAMS, length, slope).value
    assert [got[i] for i in range(50)] == pytest.approx(list(want), rel=1e-9)
    lateral = RNG.uniform(0.1, 2, (10, 50))
    force = spark.createDataFrame([(int(i), int(t), float(lateral[t, i])) for t in range(10) for i in range(50)], "comid long, t int, q_lateral double")
    whole = np.stack([x.value for x in route(net, lateral, PARAMS, length, slope)])
    basins = {(r.comid, r.t): r.q for r in ro.route_basins(reach.withColumn("basin", F.lit(1)), force, 10).collect()}
    banded = {(r.comid, r.t): r.q for r in ro.route_in_bands(reach, force, paths, 10, height=3).collect()}
    chunked = {(r.comid, r.t): r.q for r in ro.route_chunks(reach.withColumn("basin", F.lit(1)), force, 10, 3).collect()}
    chosen = [{(r.comid, r.t): r.q for r in ro.route_network(reach, force, 10, most=most, height=4).collect()} for most in (10, 1000)]
    kept = ro.route_chunks(reach.withColumn("basin", F.lit(1)), force, 10, 4, keep=reach.filter("comid in (0, 7)").select("comid"))
    assert {(r.comid, r.t) for r in kept.collect()} == {(c, t) for c in (0, 7) for t in range(10)}
    for t in range(10):
        for i in range(50):
            for other in (chunked, *chosen):
                assert other[i, t] == pytest.approx(whole[t, i], rel=1e-12)
            assert basins[i, t] == pytest.approx(whole[t, i], rel=1e-12)
            assert banded[i, t] == pytest.approx(whole[t, i], rel=1e-12)
