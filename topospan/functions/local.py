"""Span-local evaluation: each knot span carries the (p + 1)^d control points that act on it.

A span's polynomial is evaluated from its own row, at points inside it or, extended, beside it; so
solvers and tracers need no model in memory, only the rows of their batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import basis as B
from .spline import INDEX, Axes

SPAN = ("si", "sj", "sk", "sm")


def span_blocks(spans: DataFrame, controls: DataFrame, axes: Axes, name: str = "block") -> DataFrame:
    """Adds to each of `spans` its control points, as an array with the last index fastest."""
    keys = list(SPAN[: axes.dims])
    out = controls.select(*INDEX[: axes.dims], "c")
    place = F.lit(0)
    for d in range(axes.dims):
        p = axes.degree[d]
        out = out.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(p)))).withColumn(keys[d], F.col(INDEX[d]) + p - F.col("__o"))
        out = out.withColumn(f"__p{d}", F.col("__o")).drop("__o")
        place = place * (p + 1) + F.col(f"__p{d}")
    sent = out.join(spans.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col("c")))), lambda x: x["c"]).alias(name))
    return spans.join(sent, keys)


class Local:
    """Spans of a batch: numbers (S, d) and control blocks (S, p + 1, ...)."""

    def __init__(self, axes: Axes, spans: np.ndarray, blocks):
        self.axes, self.spans = axes, spans
        self.blocks = np.array([np.asarray(b, float) for b in blocks]).reshape(len(spans), *(p + 1 for p in axes.degree))
        self.lo = np.stack([axes.mins[d] + axes.knots[d][spans[:, d]] * axes.range(d) for d in range(axes.dims)], axis=1)
        self.hi = np.stack([axes.mins[d] + axes.knots[d][spans[:, d] + 1] * axes.range(d) for d in range(axes.dims)], axis=1)

    def partial(self, which: np.ndarray, x: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
        """A mixed partial derivative at points x (N, d) of the spans `which` (N)."""
        out = self.blocks[which]
        for d, k in enumerate(order):
            if k > self.axes.degree[d]:
                return np.zeros(len(x))
            u = (x[:, d] - self.axes.mins[d]) / self.axes.range(d)
            _, w = B.basis(u, self.axes.knots[d], self.axes.degree[d], k, self.spans[which, d])
            out = np.einsum("na,na...->n...", w / self.axes.range(d) ** k, out)
        return out

    def gradient(self, which, x):
        n = self.axes.dims
        return np.stack([self.partial(which, x, tuple(int(a == d) for a in range(n))) for d in range(n)], axis=1)

    def hessian(self, which, x):
        n = self.axes.dims
        out = np.empty((len(x), n, n))
        for a in range(n):
            for b in range(a, n):
                out[:, a, b] = out[:, b, a] = self.partial(which, x, tuple(int(k == a) + int(k == b) for k in range(n)))
        return out

    def jet(self, which, x, order: int) -> dict[tuple[int, int], np.ndarray]:
        """All partials of a two-dimensional model up to an order."""
        return {(a, b): self.partial(which, x, (a, b)) for a in range(order + 1) for b in range(order + 1 - a)}

    def inside(self, which, x):
        """Whether points are in their spans, borders included."""
        return ((x >= self.lo[which]) & (x <= self.hi[which])).all(axis=1)

    def in_core(self, x):
        return ((x >= np.array(self.axes.mins)) & (x <= np.array(self.axes.maxs))).all(axis=1)


def steepness(jet: dict) -> dict[tuple[int, int], np.ndarray]:
    """Jet to order 2 of g = |grad f|^2 from the jet to order 3 of f."""
    f = jet
    return {
        (0, 0): f[1, 0] ** 2 + f[0, 1] ** 2,
        (1, 0): 2 * (f[1, 0] * f[2, 0] + f[0, 1] * f[1, 1]),
        (0, 1): 2 * (f[1, 0] * f[1, 1] + f[0, 1] * f[0, 2]),
        (2, 0): 2 * (f[2, 0] ** 2 + f[1, 0] * f[3, 0] + f[1, 1] ** 2 + f[0, 1] * f[2, 1]),
        (1, 1): 2 * (f[1, 1] * f[2, 0] + f[1, 0] * f[2, 1] + f[0, 2] * f[1, 1] + f[0, 1] * f[1, 2]),
        (0, 2): 2 * (f[1, 1] ** 2 + f[1, 0] * f[1, 2] + f[0, 2] ** 2 + f[0, 1] * f[0, 3]),
    }


def jacobian(f: dict, g: dict) -> tuple[np.ndarray, np.ndarray]:
    """h = f_x g_y - f_y g_x and its gradient, from jets to order 2."""
    h = f[1, 0] * g[0, 1] - f[0, 1] * g[1, 0]
    hx = f[2, 0] * g[0, 1] + f[1, 0] * g[1, 1] - f[1, 1] * g[1, 0] - f[0, 1] * g[2, 0]
    hy = f[1, 1] * g[0, 1] + f[1, 0] * g[0, 2] - f[0, 2] * g[1, 0] - f[0, 1] * g[1, 1]
    return h, np.stack((hx, hy), axis=1)


def jacobian_hessian(f: dict, g: dict) -> np.ndarray:
    """Second derivatives of h, from jets to order 3."""
    hxx = f[3, 0] * g[0, 1] + 2 * f[2, 0] * g[1, 1] + f[1, 0] * g[2, 1] - f[2, 1] * g[1, 0] - 2 * f[1, 1] * g[2, 0] - f[0, 1] * g[3, 0]
    hxy = f[2, 1] * g[0, 1] + f[2, 0] * g[0, 2] + f[1, 0] * g[1, 2] - f[1, 2] * g[1, 0] - f[0, 2] * g[2, 0] - f[0, 1] * g[2, 1]
    hyy = f[1, 2] * g[0, 1] + 2 * f[1, 1] * g[0, 2] + f[1, 0] * g[0, 3] - f[0, 3] * g[1, 0] - 2 * f[0, 2] * g[1, 1] - f[0, 1] * g[1, 2]
    return np.stack((np.stack((hxx, hxy), axis=1), np.stack((hxy, hyy), axis=1)), axis=1)


class Field:
    """A scalar function on spans, F(x) with its gradient: what level solvers and tracers follow."""

    def __init__(self, kind: str, f: Local, g: Local | None = None, level: float = 0.0):
        self.kind, self.f, self.g, self.level = kind, f, g, level

    def __call__(self, which, x):
        if self.kind == "level":
            return self.f.partial(which, x, (0,) * x.shape[1]) - self.level, self.f.gradient(which, x)
        if self.kind == "ridge":
            jet = self.f.jet(which, x, 3)
            return jacobian(jet, steepness(jet))
        return jacobian(self.f.jet(which, x, 2), self.g.jet(which, x, 2))


def seeds(local: Local, per_dim: int, left: float = 0.0, right: float = 1.0, kind: str = "centred") -> tuple[np.ndarray, np.ndarray]:
    """(span of each seed, seeds): a grid in every span.

    centred: at (k + 1/2) / n; ends: both ends included; left: at k / n; always in [left, right] of the span.
    """
    t = {"centred": (np.arange(per_dim) + 0.5) / per_dim, "ends": np.linspace(0, 1, per_dim), "left": np.arange(per_dim) / per_dim}[kind]
    grid = np.stack([g.ravel() for g in np.meshgrid(*[left + (right - left) * t] * local.axes.dims, indexing="ij")], axis=1)
    n = len(local.spans)
    which = np.repeat(np.arange(n), len(grid))
    return which, local.lo[which] + np.tile(grid, (n, 1)) * (local.hi - local.lo)[which]


def product(values) -> int:
    return reduce(lambda a, b: a * b, values, 1)
