"""Critical-point trajectories of a model over (x, y, t): d(x, y)/dt = -H^-1 grad f_t, both ways in time."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import basis as B
from ..functions.spline import INDEX, Axes
from .solve import DET

MAX_STEPS = 5000


class Whole:
    """A model held in memory, for paths that cross spans. Its size is checked before it is sent."""

    def __init__(self, axes: Axes, controls: np.ndarray):
        self.axes, self.c = axes, controls

    def partial(self, x: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
        parts, at = [], []
        for d, k in enumerate(order):
            u = np.clip((x[:, d] - self.axes.mins[d]) / self.axes.range(d), 0, 1)
            s, w = B.basis(u, self.axes.knots[d], self.axes.degree[d], k)
            parts.append(w / self.axes.range(d) ** k)
            at.append(s[:, None] - self.axes.degree[d] + np.arange(self.axes.degree[d] + 1))
        block = self.c[at[0][:, :, None, None], at[1][:, None, :, None], at[2][:, None, None, :]]
        return np.einsum("na,nb,nc,nabc->n", *parts, block)

    def slope(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """d(x, y)/dt at points, and whether the spatial Hessian can be inverted."""
        d = cache(lambda *o: self.partial(x, o))
        a, b, c = d(2, 0, 0), d(1, 1, 0), d(0, 2, 0)
        det = a * c - b * b
        ok = np.abs(det) >= DET
        det = np.where(ok, det, 1)
        p, q = d(1, 0, 1), d(0, 1, 1)
        return np.stack((-(c * p - b * q) / det, -(a * q - b * p) / det), axis=1), ok

    def settle(self, x: np.ndarray, eps: float, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """Newton in (x, y) at fixed t."""
        x = x.copy()
        for _ in range(most):
            g = np.stack((self.partial(x, (1, 0, 0)), self.partial(x, (0, 1, 0))), axis=1)
            good = np.sqrt((g * g).sum(axis=1)) < eps
            if good.all():
                break
            a, b, c = (self.partial(x, o) for o in ((2, 0, 0), (1, 1, 0), (0, 2, 0)))
            det = a * c - b * b
            move = np.stack((c * g[:, 0] - b * g[:, 1], a * g[:, 1] - b * g[:, 0]), axis=1) / np.where(np.abs(det) < DET, np.inf, det)[:, None]
            x[:, :2] -= np.where(good[:, None], 0, move)
        return x, good


def _move(m: Whole, x, h, sign):
    """A Runge-Kutta step of length h in t, or, where that moves farther than h, of length h along the path."""

    def way(y):
        v, ok = m.slope(y)
        v = np.column_stack((v, np.ones(len(y)))) * sign
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.maximum(n, 1), ok

    k1, a = way(x)
    k2, b = way(x + h / 2 * k1)
    k3, c = way(x + h / 2 * k2)
    k4, d = way(x + h * k3)
    return x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), a & b & c & d


def trajectories(seeds: DataFrame, controls: DataFrame, axes: Axes, step: float | None = None, eps: float = 1e-8, most_controls: int = 20_000_000) -> DataFrame:
    """(trace_id, seq, x, y, t) of the path through each seed (id, x, y, t), until it leaves the box or can't go on.

    Paths cross spans, so the model goes to every task; a model of more control points is refused.
    """
    if axes.controls[0] * axes.controls[1] * axes.controls[2] > most_controls:
        raise ValueError("the model has too many control points to be sent to every task")
    h = axes.range(2) / axes.spans(2) / 8 if step is None else step
    net = np.zeros(axes.controls)
    for r in controls.select(*INDEX[:3], "c").toLocalIterator():
        net[r.i, r.j, r.k] = r.c
    sent = seeds.sparkSession.sparkContext.broadcast(net)

    def run(frames):
        m = Whole(axes, sent.value)
        for own in frames:
            start = own[["x", "y", "t"]].to_numpy(float)
            ways = []
            for sign in (-1.0, 1.0):
                paths = [[] for _ in range(len(start))]
                x, live = start.copy(), np.arange(len(start))
                for _ in range(MAX_STEPS):
                    if not len(live):
                        break
                    y, ok = _move(m, x[live], h, sign)
                    inside = ((y >= np.array(axes.mins)) & (y <= np.array(axes.maxs))).all(axis=1)
                    live, y = live[ok & inside], y[ok & inside]
                    if not len(live):
                        break
                    y, good = m.settle(y, eps)
                    good &= ((y[:, :2] - x[live][:, :2]) ** 2).sum(axis=1) < (4 * h) ** 2 * 4
                    live, y = live[good], y[good]
                    x[live] = y
                    for k, p in zip(live.tolist(), y, strict=True):
                        paths[k].append(p.copy())
                ways.append(paths)
            for k, key in enumerate(own["id"]):
                p = np.array([*reversed(ways[0][k]), start[k], *ways[1][k]])
                yield pd.DataFrame({"trace_id": key, "seq": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "t": p[:, 2]})

    return seeds.select("id", "x", "y", "t").mapInPandas(run, "trace_id long, seq int, x double, y double, t double")


def trajectory_graph(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of trajectories, z being time."""
    from .graph import numbered

    v = numbered(paths, ["trace_id", "seq"])
    e = v.select("vid", "trace_id", "seq").alias("a").join(v.select(F.col("vid").alias("to"), "trace_id", (F.col("seq") - 1).alias("seq")), ["trace_id", "seq"]).select(F.col("vid").alias("src"), F.col("to").alias("dst"))
    return v.select("vid", "x", "y", F.col("t").alias("z"), F.lit(0).alias("type")), e
