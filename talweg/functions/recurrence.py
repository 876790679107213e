"""The time-stepped sparse recurrence of one river network, on NumPy vectors."""

from __future__ import annotations

import numpy as np

from talweg.functions.physics import DELTA, DT_SECONDS, MINIMUMS
from talweg.functions.tape import Var


class Network:
    """Reaches with one downstream neighbour each (-1: none), in levels: a level solves at once, after all that drain into it."""

    def __init__(self, parent: np.ndarray):
        self.parent, self.n = parent, len(parent)
        self.inner = np.flatnonzero(parent >= 0)
        kids = np.bincount(parent[self.inner], minlength=self.n)
        self.levels: list[np.ndarray] = []
        left, now = kids.copy(), np.flatnonzero(kids == 0)
        done = 0
        while len(now):
            self.levels.append(now)
            done += len(now)
            p = parent[now]
            p = p[p >= 0]
            np.subtract.at(left, p, 1)
            p = np.unique(p)
            now = p[left[p] == 0]
        if done < self.n:
            raise ValueError("the network has a loop")

    def upstream_sum(self, x: np.ndarray) -> np.ndarray:
        """The sum of the direct upstream neighbours."""
        return np.bincount(self.parent[self.inner], weights=x[self.inner], minlength=self.n)

    def downstream_value(self, g: np.ndarray) -> np.ndarray:
        """Adjoint of ``upstream_sum``: each reach gets the value of its downstream neighbour."""
        out = np.zeros(self.n)
        out[self.inner] = g[self.parent[self.inner]]
        return out

    def solve(self, c1: np.ndarray, b: np.ndarray) -> np.ndarray:
        """x = b + c1 * (sum of upstream x), by forward substitution down the levels."""
        x, inflow = b.copy(), np.zeros(self.n)
        for now in self.levels:
            x[now] += c1[now] * inflow[now]
            p = self.parent[now]
            ok = p >= 0
            np.add.at(inflow, p[ok], x[now][ok])
        return x

    def solve_adjoint(self, c1: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The transposed system: each reach adds c1 * adjoint of its downstream neighbour."""
        y = g.copy()
        for now in reversed(self.levels):
            p = self.parent[now]
            ok = p >= 0
            y[now[ok]] += c1[p[ok]] * y[p[ok]]
        return y

    def solve_var(self, c1: Var, b: Var) -> Var:
        x = self.solve(c1.value, b.value)
        inflow = self.upstream_sum(x)
        cache: dict[int, np.ndarray] = {}

        def adjoint(g):
            if id(g) not in cache:
                cache.clear()
                cache[id(g)] = self.solve_adjoint(c1.value, g)
            return cache[id(g)]

        return Var(x, [(b, adjoint), (c1, lambda g: adjoint(g) * inflow)])

    def accumulate(self, x: np.ndarray) -> np.ndarray:
        """Each reach's own value plus all above it."""
        return self.solve(np.ones(self.n), x)


def step(net: Network, q: Var, lateral, params: dict, length, slope, dt: float = DT_SECONDS, legacy: bool = False, positive: bool = True, leak: dict | None = None, diagnostics: list | None = None,
         inflow_now=0.0, inflow_next=0.0) -> Var:
    """Discharge one step on. ``params``: n, q_spatial, p_spatial (and x_storage for legacy). ``inflow_now`` and ``inflow_next`` are flows that enter from routed parts of the river at this step and the next."""
    n, e, p = Var.of(params["n"]), Var.of(params["q_spatial"]) + 1e-6, Var.of(params["p_spatial"])
    root_s = np.sqrt(slope)
    depth = (((q * n * (e + 1.0)) / (p * root_s + 1e-8)) ** (3.0 / (e * 3.0 + 5.0))).clip(MINIMUMS["depth"])
    top = p * depth**e
    side = (top * e / (depth * 2.0)).clip(0.5, 50.0)
    bottom = (top - side * depth * 2.0).clip(MINIMUMS["bottom_width"])
    area = (top + bottom) * depth * 0.5
    flank = (side * side + 1.0) ** 0.5
    wet = bottom + depth * flank * 2.0
    velocity = ((area / wet) ** (2.0 / 3.0) * root_s / n).clip(MINIMUMS["velocity"], 15.0)
    celerity = velocity * (5.0 / 3.0) if legacy else velocity * (5.0 / 3.0 - area * flank / (top * wet) * (4.0 / 3.0))
    k = length / celerity
    if positive and not legacy:
        k = k.clip(dt * (1 + DELTA) / 2)
    if legacy:
        x = Var.of(params.get("x_storage", 0.3))
    else:
        x = ((1.0 - q / (top * slope * celerity * length + 1e-12)) * 0.5).clip(0.0, 0.5)
        if positive:
            cr = dt / k
            x = x.minimum(cr * (0.5 * (1 - DELTA))).minimum((1.0 - cr * 0.5) * (1 - DELTA))
    kx, rest = k * x * 2.0, k * (1.0 - x) * 2.0
    den = rest + dt
    c1, c2, c3, c4 = (dt - kx) / den, (kx + dt) / den, (rest - dt) / den, (2.0 * dt) / den
    inflow = q.linear(net.upstream_sum, net.downstream_value) + inflow_now
    b = c2 * inflow + c3 * q + c4 * lateral + c1 * inflow_next
    if leak is not None:
        head = depth - leak["d_gw"]
        head = head.clip(0.0) if leak.get("losing_only", True) else head
        b = b - leak["factor"] * (p * depth) ** e * length * leak["k_d"] * head * leak.get("mask", 1.0)
    out = net.solve_var(c1, b)
    if diagnostics is not None:
        diagnostics.append({"courant": dt / k.value, "x": np.broadcast_to(x.value, (net.n,)), "c1": c1.value, "c3": c3.value, "negative": int((out.value < 0).sum()), "total": float(out.value.sum())})
    return out.clip(MINIMUMS["discharge"])


def route(net: Network, lateral: np.ndarray, params: dict, length: np.ndarray, slope: np.ndarray, start: np.ndarray | None = None, pieces: np.ndarray | float = 1.0, boundary: np.ndarray | None = None, **options) -> list[Var]:
    """Discharge at every step: the first is ``start`` or the steady state of the first lateral inflow, each further one is driven by the inflow before it.

    ``lateral`` (steps, reaches) is floored, then divided by the pieces of its reach; ``boundary`` holds what flows in
    from routed reaches outside (hours may be Vars). Where neither parameters nor leak are to be differentiated, no step keeps what it was made of.
    """
    lateral = np.maximum(lateral, MINIMUMS["discharge"]) / pieces
    slope = np.maximum(slope, MINIMUMS["slope"])
    edge = np.zeros_like(lateral) if boundary is None else boundary
    first = np.maximum(net.accumulate(lateral[0] + Var.of(edge[0]).value), MINIMUMS["discharge"]) if start is None else start
    out = [Var(first)]
    taped = any(isinstance(x, Var) for x in [*params.values(), *(options.get("leak") or {}).values()])
    for t in range(1, len(lateral)):
        q = step(net, out[-1], lateral[t - 1], params, length, slope, inflow_now=edge[t - 1], inflow_next=edge[t], **options)
        out.append(q if taped else Var(q.value))
    return out
