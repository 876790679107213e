import numpy as np
import pytest
from talweg.functions.recurrence import Network, route
from talweg.functions.tape import Var
from talweg.operators import model as m


def test_spline_basis():
    x = np.linspace(-0.99, 0.99, 41)
    for order in (2, 3):
        b, db = m.spline_basis(x, 5, order)
        assert b.shape == (41, 5 + order)
        assert b.sum(axis=-1) == pytest.approx(np.ones(41))
        up, down = m.spline_basis(x + 1e-6, 5, order)[0], m.spline_basis(x - 1e-6, 5, order)[0]
        assert db == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_head_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    w, x = m.init_head(3, 2, hidden=4, layers=2), rng.normal(0, 0.3, (5, 3))
    v = {k: a if k == "shape" else Var(a) for k, a in w.items()}
    m.head(v, x).sum().backward()
    for k in ("in_w", "base0", "coef0", "coef1", "out_w", "out_b"):
        at = tuple(0 for _ in w[k].shape)
        up, down = dict(w), dict(w)
        up[k], down[k] = w[k].copy(), w[k].copy()
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert v[k].grad[at] == pytest.approx((m.head(up, x).value.sum() - m.head(down, x).value.sum()) / 2e-6, rel=1e-4, abs=1e-8)


def test_predict_and_disaggregate(spark):
    w = m.init_head(2, 3)
    df = spark.createDataFrame([(i, i / 10, None if i == 3 else -i / 10, "x") for i in range(12)], "comid long, a double, b double, n string")
    got = {r.comid: (r.n, r.q, r.p) for r in m.predict(df, "comid", ["a", "b"], ["n", "q", "p"], w).collect()}
    assert got[5] == pytest.approx(tuple(m.head(w, np.array([[0.5, -0.5]])).value[0]))
    assert all(0 < y < 1 for v in got.values() for y in v)
    assert m.predict(df.limit(0), "comid", ["a", "b"], ["n", "q", "p"], w).count() == 0
    days = spark.createDataFrame([(1, 5.0, [0.1] * 24), (2, 0.0, None), (3, None, [0.0] * 24), (4, 2.0, [1.0])], "id long, q double, rain array<double>")
    h = {r.id: r.hours for r in m.disaggregate(days, ["id"], "q", "rain", m.init_head(25, 24)).collect()}
    assert h[3] is None and np.mean(h[1]) == pytest.approx(5.0) and np.mean(h[4]) == pytest.approx(2.0) and h[2] == [0.0] * 24


def test_optimizers_reach_the_minimum():
    for opt, n in ((m.Adam(0.05), 400), (m.AdaDelta(), 3000)):
        w = {"a": np.array([3.0, -2.0])}
        for _ in range(n):
            w = opt.step(w, {"a": 2 * (w["a"] - 1)})
        assert w["a"] == pytest.approx([1, 1], abs=0.05)
    assert np.linalg.norm(m.clip_norm({"a": np.array([3.0, 4.0])}, 1.0)["a"]) == pytest.approx(1)


def test_training_over_basins_learns(spark):
    rng = np.random.default_rng(2)
    rows, steps = [], 8
    for b in range(4):
        n = 6
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        length, slope, attr = rng.uniform(2000, 9000, n), rng.uniform(1e-3, 0.02, n), rng.normal(0, 0.4, (n, 2))
        lateral = rng.uniform(0.2, 3, (steps, n))
        truth = np.stack([q.value for q in route(Network(parent), lateral, {"n": np.full(n, 0.2), "q_spatial": 0.2, "p_spatial": 60.0}, length, slope)])
        for i in range(n):
            rows.append((b, b * 100 + i, b * 100 + int(parent[i]) if parent[i] >= 0 else None, float(length[i]), float(slope[i]), float(attr[i, 0]), float(attr[i, 1]), lateral[:, i].tolist(), truth[:, i].tolist()))
    df = spark.createDataFrame(rows, "basin long, comid long, parent long, length_m double, slope double, a1 double, a2 double, lateral array<double>, observed array<double>")
    w0 = m.init_head(2, 3, hidden=4, layers=1)
    loss = m.routing_loss(["a1", "a2"], steps)
    value, g = m.summed_gradient(df, "basin", w0, loss)
    up, down = dict(w0), dict(w0)
    up["out_b"], down["out_b"] = w0["out_b"] + [1e-5, 0, 0], w0["out_b"] - [1e-5, 0, 0]
    assert g["out_b"][0] == pytest.approx((m.summed_gradient(df, "basin", up, loss)[0] - m.summed_gradient(df, "basin", down, loss)[0]) / 2e-5, rel=1e-3)
    _, losses = m.train(df, "basin", w0, loss, steps=8, optimizer=m.Adam(0.1))
    assert losses[-1] < losses[0] * 0.8


def test_a_resumed_run_goes_on_the_same(tmp_path):
    g = {"a": np.array([0.3, -0.2])}
    opt, w = m.Adam(0.1), {"a": np.array([1.0, 2.0])}
    for _ in range(3):
        w = opt.step(w, g)
    m.save_state(str(tmp_path / "s.npz"), w, opt, 3)
    again = m.Adam(0.5)
    w2, step = m.load_state(str(tmp_path / "s.npz"), again)
    assert step == 3 and again.lr == 0.1
    assert again.step(w2, g)["a"] == pytest.approx(opt.step(w, g)["a"], abs=0)
    with pytest.raises(ValueError):
        m.load_state(str(tmp_path / "s.npz"), m.AdaDelta())
