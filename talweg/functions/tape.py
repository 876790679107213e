"""Reverse-mode differentiation over NumPy vectors: just the operations that routing and its parameter heads need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _unbroadcast(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


class Var:
    """A value, and how a gradient flows back from it."""

    __array_priority__ = 100

    def __init__(self, value, back: list[tuple[Var, Callable]] | None = None):
        self.value = np.asarray(value, float)
        self.back = back or []
        self.grad: np.ndarray | None = None

    @staticmethod
    def of(x) -> Var:
        return x if isinstance(x, Var) else Var(x)

    def __add__(self, o):
        o = Var.of(o)
        return Var(self.value + o.value, [(self, lambda g: g), (o, lambda g: g)])

    def __mul__(self, o):
        o = Var.of(o)
        return Var(self.value * o.value, [(self, lambda g: g * o.value), (o, lambda g: g * self.value)])

    def __pow__(self, o):
        o = Var.of(o)
        y = self.value**o.value
        return Var(y, [(self, lambda g: g * o.value * self.value ** (o.value - 1)), (o, lambda g: g * y * np.log(np.where(self.value > 0, self.value, 1.0)))])

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + Var.of(o) * -1.0

    def __rsub__(self, o):
        return Var.of(o) - self

    def __truediv__(self, o):
        return self * Var.of(o) ** -1.0

    def __rtruediv__(self, o):
        return Var.of(o) / self

    def __matmul__(self, o):
        o = Var.of(o)
        return Var(self.value @ o.value, [(self, lambda g: g @ o.value.T), (o, lambda g: self.value.T @ g)])

    __radd__ = __add__
    __rmul__ = __mul__

    def exp(self):
        y = np.exp(self.value)
        return Var(y, [(self, lambda g: g * y)])

    def sigmoid(self):
        y = 1 / (1 + np.exp(-self.value))
        return Var(y, [(self, lambda g: g * y * (1 - y))])

    def clip(self, lo: float | None, hi: float | None = None):
        y = np.clip(self.value, lo, hi)
        return Var(y, [(self, lambda g: g * (y == self.value))])

    def minimum(self, o):
        o = Var.of(o)
        first = self.value <= o.value
        return Var(np.where(first, self.value, o.value), [(self, lambda g: g * first), (o, lambda g: g * ~first)])

    def abs(self):
        return Var(np.abs(self.value), [(self, lambda g: g * np.sign(self.value))])

    def __getitem__(self, i):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, i, g)
            return out

        return Var(self.value[i], [(self, back)])

    def sum(self):
        return Var(self.value.sum(), [(self, lambda g: np.broadcast_to(g, self.value.shape))])

    def linear(self, forward: Callable, adjoint: Callable):
        """A linear map with its adjoint."""
        return Var(forward(self.value), [(self, adjoint)])

    def backward(self) -> None:
        order, seen = [], set()
        stack: list[tuple[Var, bool]] = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((p, False) for p, _ in v.back)
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            if v.grad is None:
                continue
            for p, f in v.back:
                g = _unbroadcast(np.asarray(f(v.grad), float), p.value.shape)
                p.grad = g.copy() if p.grad is None else p.grad + g


def stack(rows: list[Var]) -> Var:
    """Vectors of one length as the rows of a matrix."""
    return Var(np.stack([r.value for r in rows]), [(r, lambda g, i=i: g[i]) for i, r in enumerate(rows)])
