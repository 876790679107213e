"""Spline heads that turn attributes into parameters, disaggregation of daily flow, optimizers and training over basins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.tape import Var, stack

Weights = dict[str, np.ndarray]


def init_head(n_in: int, n_out: int, hidden: int = 21, layers: int = 2, grid: int = 5, order: int = 3, seed: int = 42) -> Weights:
    """Seeded weights: Kaiming for the way in, Xavier for the way out, small random splines."""
    rng = np.random.default_rng(seed)
    w: Weights = {"in_w": rng.normal(0, np.sqrt(2 / n_in), (n_in, hidden)), "in_b": np.zeros(hidden)}
    for k in range(layers):
        w[f"base{k}"] = rng.normal(0, np.sqrt(1 / hidden), (hidden, hidden))
        w[f"coef{k}"] = rng.normal(0, 0.3 / grid, (hidden, hidden, grid + order))
    w |= {"out_w": rng.normal(0, np.sqrt(2 / (hidden + n_out)), (hidden, n_out)), "out_b": np.zeros(n_out), "shape": np.array([layers, grid, order])}
    return w


def spline_basis(x: np.ndarray, grid: int, order: int, low: float = -1.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """B-spline values and derivatives on an even grid over [low, high], widened by ``order`` knots at either end: (..., grid + order)."""
    step = (high - low) / grid
    knots = low + step * np.arange(-order, grid + order + 1)
    x = x[..., None]
    b = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    slope = np.zeros_like(b)
    for k in range(1, order + 1):
        if k == order:
            slope = k * (b[..., :-1] / (step * k) - b[..., 1:] / (step * k))
        b = (x - knots[: -k - 1]) / (step * k) * b[..., :-1] + (knots[k + 1 :] - x) / (step * k) * b[..., 1:]
    return b, slope


def spline_layer(x: Var, base: Var, coef: Var, grid: int, order: int) -> Var:
    """sum over inputs of base * silu(x) + spline(x)."""
    b, db = spline_basis(x.value, grid, order)
    y = Var(np.einsum("nim,iom->no", b, coef.value), [
        (x, lambda g: np.einsum("no,nim,iom->ni", g, db, coef.value)),
        (coef, lambda g: np.einsum("no,nim->iom", g, b)),
    ])
    return (x * x.sigmoid()) @ base + y


def head_logits(weights: dict[str, Var | np.ndarray], x) -> Var:
    layers, grid, order = (int(v) for v in np.asarray(weights["shape"]))
    w = {k: Var.of(v) for k, v in weights.items() if k != "shape"}
    h = Var.of(x) @ w["in_w"] + w["in_b"]
    for k in range(layers):
        h = spline_layer(h, w[f"base{k}"], w[f"coef{k}"], grid, order)
    return h @ w["out_w"] + w["out_b"]


def head(weights: dict, x) -> Var:
    """Shares in (0, 1): (rows, outputs)."""
    return head_logits(weights, x).sigmoid()


def predict(attributes: DataFrame, key: str, inputs: list[str], outputs: list[str], weights: Weights) -> DataFrame:
    """(key, outputs): the head over a table of any size, in Arrow batches; a null input counts as 0 (the mean, once standardised)."""
    kind = dict(attributes.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = head(weights, b[inputs].fillna(0.0).to_numpy("f8")).value if len(b) else np.empty((0, len(outputs)))
            yield pd.DataFrame({key: b[key], **{o: y[:, i] for i, o in enumerate(outputs)}})

    return attributes.select(key, *[F.col(c).cast("double").alias(c) for c in inputs]).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{o}` double" for o in outputs))


def disaggregate(days: DataFrame, key: list[str], daily: str, rain: str, weights: Weights) -> DataFrame:
    """(key, hours): a day's mean flow and 24 hours of rain to 24 hourly flows whose mean is the daily flow. A null day gives null, a negative one is spread like a dry one; missing rain is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = b[daily].fillna(0.0).to_numpy("f8")
            r = np.array([np.nan_to_num(np.asarray(a, "f8")) if a is not None and len(a) == 24 else np.zeros(24) for a in b[rain]]).reshape(-1, 24)
            z = head_logits(weights, np.hstack([np.log(np.maximum(q, 0.0) + 1e-6)[:, None], r])).value
            e = np.exp(z - z.max(axis=1, keepdims=True))
            h = 24 * q[:, None] * e / e.sum(axis=1, keepdims=True)
            yield b[key].assign(hours=[x if ok else None for x, ok in zip(h, b[daily].notna())])

    types = dict(days.dtypes)
    return days.select(*key, daily, rain).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in key) + ", hours array<double>")


def save_state(path: str, weights: Weights, optimizer: Adam | AdaDelta, step: int) -> None:
    """Weights, moments and the step as one file, whole or not at all."""
    import os

    moments = {f"o_{n}_{k}": x for n, d in vars(optimizer).items() if isinstance(d, dict) for k, x in d.items()}
    scalars = {f"s_{n}": np.array(x) for n, x in vars(optimizer).items() if not isinstance(x, dict)}
    with open(f"{path}.tmp", "wb") as f:
        np.savez(f, kind=np.array(type(optimizer).__name__), step=np.array(step), **{f"w_{k}": x for k, x in weights.items()}, **moments, **scalars)
    os.replace(f"{path}.tmp", path)


def load_state(path: str, optimizer: Adam | AdaDelta) -> tuple[Weights, int]:
    """Weights and step; the moments go into ``optimizer``, which must be of the kind that was saved."""
    with np.load(path) as z:
        if str(z["kind"]) != type(optimizer).__name__:
            raise ValueError(f"saved by {z['kind']}")
        for n, x in vars(optimizer).items():
            if isinstance(x, dict):
                setattr(optimizer, n, {k[len(f"o_{n}_") :]: z[k] for k in z.files if k.startswith(f"o_{n}_")})
            elif f"s_{n}" in z.files:
                setattr(optimizer, n, z[f"s_{n}"].item())
        return {k[2:]: z[k] for k in z.files if k.startswith("w_")}, int(z["step"])


class Adam:
    def __init__(self, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.lr, self.b1, self.b2, self.eps, self.t = lr, b1, b2, eps, 0
        self.m: Weights = {}
        self.v: Weights = {}

    def step(self, w: Weights, g: Weights) -> Weights:
        self.t += 1
        out = dict(w)
        for k, d in g.items():
            self.m[k] = self.b1 * self.m.get(k, 0) + (1 - self.b1) * d
            self.v[k] = self.b2 * self.v.get(k, 0) + (1 - self.b2) * d * d
            out[k] = w[k] - self.lr * (self.m[k] / (1 - self.b1**self.t)) / (np.sqrt(self.v[k] / (1 - self.b2**self.t)) + self.eps)
        return out


class AdaDelta:
    def __init__(self, lr: float = 1.0, rho: float = 0.9, eps: float = 1e-6):
        self.lr, self.rho, self.eps = lr, rho, eps
        self.square: Weights = {}
        self.moved: Weights = {}

    def step(self, w: Weights, g: Weights) -> Weights:
        out = dict(w)
        for k, d in g.items():
            self.square[k] = self.rho * self.square.get(k, 0) + (1 - self.rho) * d * d
            move = np.sqrt(np.asarray(self.moved.get(k, 0)) + self.eps) / np.sqrt(self.square[k] + self.eps) * d
            self.moved[k] = self.rho * self.moved.get(k, 0) + (1 - self.rho) * move * move
            out[k] = w[k] - self.lr * move
        return out


def clip_norm(g: Weights, most: float) -> Weights:
    """Gradients scaled so that their joint length is ``most`` at the most."""
    n = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
    return g if n <= most else {k: d * (most / n) for k, d in g.items()}


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w) if k != "shape"])


def unflatten(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        if k != "shape":
            out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
            at += like[k].size
    return out


def summed_gradient(groups: DataFrame, by: str, weights: Weights, loss: Callable[[dict, pd.DataFrame], tuple[Var, float]]) -> tuple[float, Weights]:
    """Loss and gradient over all groups. ``loss`` gives a group's summed loss and its number of terms.

    Each group is differentiated where it lies; a task adds up what it has, the sums are added up per component, so what
    reaches the driver is one vector as long as the weights.
    """

    def part(batch: pd.DataFrame) -> pd.DataFrame:
        w = {k: v if k == "shape" else Var(v) for k, v in weights.items()}
        value, n = loss(w, batch)
        value.backward()
        g = np.concatenate([(w[k].grad if w[k].grad is not None else np.zeros_like(w[k].value)).ravel() for k in sorted(w) if k != "shape"])
        return pd.DataFrame({"i": np.arange(-2, len(g)), "g": np.r_[float(value.value), n, g]})

    sums = groups.groupBy(by).applyInPandas(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g"))
    flat = np.array([r["g"] for r in sums.orderBy("i").collect()])
    n = max(flat[1], 1.0)
    return float(flat[0] / n), unflatten(flat[2:] / n, weights)


def train(groups: DataFrame, by: str, weights: Weights, loss: Callable, steps: int = 20, optimizer: Adam | AdaDelta | None = None, most: float = 1.0) -> tuple[Weights, list[float]]:
    """Gradient steps over all groups; the losses before each step."""
    opt, losses = optimizer or Adam(1e-2), []
    for _ in range(steps):
        value, g = summed_gradient(groups, by, weights, loss)
        losses.append(value)
        weights = opt.step(weights, clip_norm(g, most))
    return weights, losses


def routing_loss(inputs: list[str], steps: int) -> Callable:
    """Squared error at the outlet of a basin routed with n, q_spatial and p_spatial from the head.

    A group has its reaches: comid, parent, length_m, slope, the inputs, ``lateral`` (an array of ``steps``) and, at the
    outlet, ``observed``.
    """
    from talweg.functions.physics import RANGES
    from talweg.functions.recurrence import Network, route

    def loss(w: dict, rows: pd.DataFrame) -> tuple[Var, float]:
        rows = rows.sort_values("comid", ignore_index=True)
        ids = pd.Index(rows["comid"])
        net = Network(ids.get_indexer(rows["parent"].fillna(-1).astype("int64")))
        y = head(w, rows[inputs].to_numpy("f8"))
        n = y[:, 0] * (RANGES["n"][1] - RANGES["n"][0]) + RANGES["n"][0]
        lo, hi = np.log(RANGES["p_spatial"][0] + 1e-6), np.log(RANGES["p_spatial"][1])
        params = {"n": n, "q_spatial": y[:, 1], "p_spatial": (y[:, 2] * (hi - lo) + lo).exp()}
        qs = route(net, np.stack(rows["lateral"]).T[:steps], params, rows["length_m"].to_numpy("f8"), rows["slope"].to_numpy("f8"))
        out = np.flatnonzero(net.parent < 0)
        total, count = Var(0.0), 0
        for i in out:
            obs = np.asarray(rows["observed"][i], "f8")[1:steps]
            d = stack([q[i] for q in qs[1:]]) - obs
            total, count = total + (d * d).sum(), count + len(obs)
        return total, count

    return loss
