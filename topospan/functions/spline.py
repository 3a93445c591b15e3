"""Tensor-product B-spline models of gridded fields, as joins and sums.

A model is its `Axes` (degree, number of control points and bounds of every dimension; driver-side
and small) and a DataFrame of control points (i, j, ..., c). Encoding is separable least squares:
per dimension each sample is spread to the p + 1 basis functions that it touches (a join with a
table of len(axis) x (p + 1) rows), summed by control point, and the banded normal equations are
solved for blocks of lines. Decoding joins control points with basis tables and sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import basis as B

INDEX = ("i", "j", "k", "m")
AXES = ("x", "y", "z", "t")
LINES = 4096


@dataclass
class Axes:
    """Degree, control points, bounds and knots of each dimension."""

    degree: list[int]
    controls: list[int]
    mins: list[float]
    maxs: list[float]
    knots: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.knots = self.knots or [B.clamped_knots(n, p) for n, p in zip(self.controls, self.degree, strict=True)]

    @property
    def dims(self) -> int:
        return len(self.degree)

    def range(self, d: int) -> float:
        return self.maxs[d] - self.mins[d]

    def spans(self, d: int) -> int:
        return self.controls[d] - self.degree[d]

    def span_size(self) -> tuple[float, float]:
        """The least and the largest knot span that isn't empty, in the domain's units."""
        steps = [x * self.range(d) for d, k in enumerate(self.knots) for x in np.diff(k) if x > 0]
        return min(steps), max(steps)


def _basis_table(spark: SparkSession, u: np.ndarray, axes: Axes, d: int, derivative: int, index: str, control: str) -> DataFrame:
    """(index, control, w): the p + 1 weights at each of an axis' parameters, a derivative scaled to the domain's units."""
    s, values = B.basis(u, axes.knots[d], axes.degree[d], derivative)
    p = axes.degree[d]
    rows = pd.DataFrame({index: np.repeat(np.arange(len(u)), p + 1), control: (s[:, None] - p + np.arange(p + 1)).ravel(), "w": values.ravel() / axes.range(d) ** derivative})
    out = spark.createDataFrame(rows).select(F.col(index).cast("long").alias(index), F.col(control).cast("long").alias(control), "w")
    return F.broadcast(out) if len(rows) <= 1_000_000 else out


def parameters(n: int) -> np.ndarray:
    """Parameters of n evenly spaced samples."""
    return np.linspace(0, 1, n)


def encode(samples: DataFrame, points: Sequence[int], axes: Axes, smooth: float = 0.0, orders: tuple[int, ...] = (2,), value: str = "value") -> DataFrame:
    """Least-squares control points (i, j, ..., c) of samples (i, j, ..., value) on a regular grid."""
    spark = samples.sparkSession
    names = list(INDEX[: axes.dims])
    out = samples.select(*names, F.col(value).cast("double").alias("c"))
    for d, n in enumerate(points):
        u = parameters(n)
        rest = [x for x in names if x != names[d]]
        table = _basis_table(spark, u, axes, d, 0, names[d], "__control")
        sums = out.join(table, names[d]).groupBy(*rest, F.col("__control").alias(names[d])).agg(F.sum(F.col("w") * F.col("c")).alias("c"))
        normal = B.normal_matrix(u, axes.controls[d], axes.degree[d], smooth, orders, axes.knots[d])
        lines = 1
        for k in range(axes.dims):
            if k != d:
                lines *= axes.controls[k] if k < d else points[k]
        out = _solved(sums, names, d, normal, max(1, -(-lines // LINES)))
    return out


def _solved(sums: DataFrame, names: list[str], d: int, normal: np.ndarray, groups: int) -> DataFrame:
    """Solves the normal equations along dimension d, many lines at a time."""
    rest = [x for x in names if x != names[d]]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        keys, line = (np.unique(own[rest].to_numpy(), axis=0, return_inverse=True)) if rest else (np.zeros((1, 0), int), np.zeros(len(own), int))
        right = np.zeros((normal.shape[0], len(keys)))
        right[own[names[d]], line.ravel()] = own["c"]
        got = np.linalg.solve(normal, right)
        out = pd.DataFrame(np.repeat(keys, normal.shape[0], axis=0), columns=rest)
        out[names[d]] = np.tile(np.arange(normal.shape[0]), len(keys))
        out["c"] = got.T.ravel()
        return out[[*names, "c"]]

    grouped = sums.groupBy(F.pmod(F.xxhash64(*rest), F.lit(groups)).alias("__g")) if rest else sums.groupBy()
    return grouped.applyInPandas(run, ", ".join(f"{x} long" for x in names) + ", c double")


def decode(controls: DataFrame, axes: Axes, at: Sequence[np.ndarray], derivatives: Sequence[int] | None = None, value: str = "value") -> DataFrame:
    """The model, or a mixed partial derivative of it, on the grid of the parameters `at`: (i, j, ..., value)."""
    names = INDEX[: axes.dims]
    derivatives = derivatives or [0] * axes.dims
    out = controls.select(*names, "c")
    for d in range(axes.dims):
        rest = [x for x in names if x != names[d]]
        table = _basis_table(controls.sparkSession, np.asarray(at[d]), axes, d, derivatives[d], "__at", names[d])
        out = out.join(table, names[d]).groupBy(*rest, F.col("__at").alias(names[d])).agg(F.sum(F.col("w") * F.col("c")).alias("c"))
    return out.select(*names, F.col("c").alias(value))


def resample(controls: DataFrame, axes: Axes, factors: Sequence[int], derivatives: Sequence[int] | None = None, box: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The model on `factor` steps a span, spans [a, b) of `box` only: (i, j, ..., x, y, ..., value)."""
    at = []
    for d, f in enumerate(factors):
        a, b = box[d] if box else (0, axes.spans(d))
        at.append(np.linspace(a / axes.spans(d), b / axes.spans(d), f * (b - a) + 1))
    out = decode(controls, axes, at, derivatives)
    step = lambda d: (at[d][-1] - at[d][0]) * axes.range(d) / max(len(at[d]) - 1, 1)
    return out.withColumns({AXES[d]: F.lit(axes.mins[d] + float(at[d][0]) * axes.range(d)) + F.col(INDEX[d]) * step(d) for d in range(axes.dims)})


def derivative_net(controls: DataFrame, axes: Axes, d: int, order: int = 1) -> DataFrame:
    """Control points of the order-th partial derivative in dimension d, in the domain's units (one fewer each order)."""
    names = INDEX[: axes.dims]
    out = controls.select(*names, "c")
    for k in range(1, order + 1):
        p, knots, n = axes.degree[d], axes.knots[d], axes.controls[d] - k
        width = knots[p + 1 : p + 1 + n] - knots[k : k + n]
        factor = np.divide(p - k + 1, width * axes.range(d), out=np.zeros(n), where=width > 0)
        table = F.broadcast(controls.sparkSession.createDataFrame(pd.DataFrame({names[d]: np.arange(n), "__f": factor})))  # an axis
        line = W.partitionBy(*(x for x in names if x != names[d])).orderBy(names[d])
        out = out.withColumn("__next", F.lead("c").over(line)).join(table, names[d]).select(*names, ((F.col("__next") - F.col("c")) * F.col("__f")).alias("c"))
    return out


def zoom_weights(n: int, factor: float) -> np.ndarray:
    """Rows of weights (new samples x old): the interpolating cubic spline, mirrored at its ends, at evenly spaced places from end to end."""
    mirrored = lambda i: np.abs((i + n - 1) % max(2 * n - 2, 1) - n + 1)
    rows = np.arange(n)
    inner = np.zeros((n, n))
    for o, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
        np.add.at(inner, (rows, mirrored(rows + o)), w)
    m = max(round(n * factor), 1)
    x = np.arange(m) * ((n - 1) / max(m - 1, 1))
    low = np.floor(x).astype(int)
    outer = np.zeros((m, n))
    for o in (-1, 0, 1, 2):
        a = np.abs(x - low - o)
        np.add.at(outer, (np.arange(m), mirrored(low + o)), np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.maximum(2 - a, 0) ** 3 / 6))
    return outer @ np.linalg.inv(inner)


def zoomed(field: DataFrame, shape: Sequence[int], factor: float = 0.5, value: str = "value") -> DataFrame:
    """A field (i, j, ..., value) resampled by a cubic spline through its samples, axis by axis: joins with a table of an axis, and sums."""
    names = list(INDEX[: len(shape)])
    out = field.select(*names, F.col(value).cast("double").alias("c"))
    for d, n in enumerate(shape):
        w = zoom_weights(n, factor)
        at, old = np.nonzero(np.abs(w) > 1e-16)  # weights fall by 0.27 a sample
        table = out.sparkSession.createDataFrame(pd.DataFrame({"__at": at, names[d]: old, "__w": w[at, old]}))
        table = F.broadcast(table) if len(at) <= 1_000_000 else table
        rest = [x for x in names if x != names[d]]
        out = out.join(table, names[d]).groupBy(*rest, F.col("__at").alias(names[d])).agg(F.sum(F.col("__w") * F.col("c")).alias("c"))
    return out.select(*names, F.col("c").alias(value))


def derivative_nets(controls: DataFrame, axes: Axes) -> DataFrame:
    """All first-derivative nets: (d, i, j, ..., c)."""
    nets = [derivative_net(controls, axes, d).withColumn("d", F.lit(d)) for d in range(axes.dims)]
    out = nets[0]
    for x in nets[1:]:
        out = out.unionByName(x)
    return out


def net_coordinates(net: DataFrame, axes: Axes, d: int | None = None) -> DataFrame:
    """Adds the domain coordinates of control points; d: the differentiated dimension, if any."""
    out = net
    for k in range(axes.dims):
        g = B.derivative_coordinates(axes.knots[k], axes.degree[k]) if k == d else B.greville(axes.knots[k], axes.degree[k])
        table = net.sparkSession.createDataFrame(pd.DataFrame({INDEX[k]: np.arange(len(g)), AXES[k]: axes.mins[k] + g * axes.range(k)}))
        out = out.join(F.broadcast(table), INDEX[k])  # an axis
    return out


def encode_adaptive(samples: DataFrame, points: Sequence[int], degree: Sequence[int], mins: Sequence[float], maxs: Sequence[float], most_error: float, start: Sequence[int] | None = None, most_rounds: int = 8) -> tuple[Axes, DataFrame]:
    """Halves the knot spans that hold a residual over `most_error`, until none does or can be halved, or after `most_rounds`.

    The bound may be missed then: `range_error` gives the error that was reached.

    The residual's maxima come back by span of each axis (as many rows as the axes have spans).
    """
    axes = Axes(list(degree), list(start or [p + 1 for p in degree]), list(mins), list(maxs))
    names = INDEX[: axes.dims]
    controls = encode(samples, points, axes)
    for _ in range(most_rounds):
        back = decode(controls, axes, [parameters(n) for n in points], value="back")
        error = samples.select(*names, "value").join(back, list(names)).select(*names, F.abs(F.col("value") - F.col("back")).alias("e")).where(F.col("e") > most_error)
        bad = error.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(names[d]).alias("n")) for d in range(axes.dims)))).alias("x")).select("x.d", "x.n").distinct().collect()
        if not bad:
            break
        knots = []
        for d in range(axes.dims):
            k, p = axes.knots[d], axes.degree[d]
            own = {int(s) for s in B.spans_of(np.array([r.n / max(points[d] - 1, 1) for r in bad if r.d == d]), k, p)}
            extra = [(k[s] + k[s + 1]) / 2 for s in own if (k[s + 1] - k[s]) * (points[d] - 1) > 2]
            room = max(points[d] - (len(k) - p - 1), 0)  # no more control points than samples
            knots.append(np.sort(np.concatenate((k, sorted(extra)[:room]))))
        if all(len(a) == len(b) for a, b in zip(knots, axes.knots, strict=True)):
            break
        axes = Axes(axes.degree, [len(k) - p - 1 for k, p in zip(knots, axes.degree, strict=True)], axes.mins, axes.maxs, knots)
        controls = encode(samples, points, axes)
    return axes, controls


def range_error(samples: DataFrame, decoded: DataFrame, dims: int) -> DataFrame:
    """One row: n, max_error, rms_error, max_relative (to the samples' range)."""
    names = list(INDEX[:dims])
    both = samples.select(*names, "value").join(decoded.select(*names, F.col("value").alias("back")), names)
    e = F.abs(F.col("value") - F.col("back"))
    return both.agg(F.count("*").alias("n"), F.max(e).alias("max_error"), F.sqrt(F.avg(e * e)).alias("rms_error"), (F.max(e) / (F.max("value") - F.min("value"))).alias("max_relative"))


def error_norms(a: DataFrame, dims: int, value: str = "value", truth: str = "truth", box: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """One row: l1, l2 and linf of |value - truth|, inside a box of coordinates if one is given."""
    for c, (lo, hi) in zip(AXES[:dims], box or (), strict=False):
        a = a.where(F.col(c).between(lo, hi))
    e = F.abs(F.col(value) - F.col(truth))
    return a.agg(F.avg(e).alias("l1"), F.sqrt(F.avg(e * e)).alias("l2"), F.max(e).alias("linf"))


def control_range(controls: DataFrame) -> DataFrame:
    """1 / (max - min) of the control points."""
    return controls.agg((1 / (F.max("c") - F.min("c"))).alias("coefficient"))


def blend(parts: DataFrame, weight: str = "w", value: str = "value", keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """Overlapping blocks' values as weighted means by point."""
    return parts.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value))


def _within(where, overlap: float):
    return lambda k: (where >= k - overlap) & (where <= k + 1 + overlap)


def blocks(points: DataFrame, counts: Sequence[int], mins: Sequence[float], maxs: Sequence[float], overlap: float = 0.0) -> DataFrame:
    """Deals points to the blocks of a regular decomposition whose ghosted bounds hold them: adds block_id and the blending weight w.

    The weight falls linearly from 1 in the core to 0 at the end of the overlap (a share of a block).
    """
    out = points.withColumns({"block_id": F.lit(0).cast("long"), "w": F.lit(1.0)})
    step = 1
    for c, n, a, b in zip(AXES, counts, mins, maxs, strict=False):
        size = (b - a) / n
        where = (F.col(c) - a) / size
        near = F.filter(F.sequence(F.greatest(F.floor(where - overlap), F.lit(0)), F.least(F.floor(where + overlap), F.lit(n - 1))), _within(where, overlap))
        out = out.withColumn("__b", F.explode(near))
        off = F.greatest(F.col("__b") - where, where - F.col("__b") - 1, F.lit(0.0))
        share = F.lit(1.0) - off / overlap if overlap else F.lit(1.0)
        out = out.withColumns({"block_id": F.col("block_id") + F.col("__b") * step, "w": F.col("w") * F.greatest(share, F.lit(1e-9))}).drop("__b")
        step *= n
    return out


def owner_of_max_error(errors: DataFrame) -> DataFrame:
    """One row: the largest error over blocks, and the block that has it."""
    return errors.agg(F.max("error").alias("max_error"), F.max_by("block_id", F.struct("error", -F.col("block_id"))).alias("block_id"))


def sampled_jet(controls: DataFrame, axes: Axes, at: Sequence[np.ndarray], orders: dict[str, tuple[int, int]]) -> DataFrame:
    """Several partial derivatives of a two-dimensional model on one grid of parameters, as columns named by `orders`."""
    out = None
    for name, order in orders.items():
        own = decode(controls, axes, at, order, name)
        out = own if out is None else out.join(own, ["i", "j"])
    return out


def sampled_steepness(controls: DataFrame, axes: Axes, at: Sequence[np.ndarray]) -> DataFrame:
    """(i, j, value, steepness): the model and |grad f|^2."""
    jet = sampled_jet(controls, axes, at, {"value": (0, 0), "fx": (1, 0), "fy": (0, 1)})
    return jet.select("i", "j", "value", (F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")).alias("steepness"))


def sampled_ridge_function(controls: DataFrame, axes: Axes, at: Sequence[np.ndarray]) -> DataFrame:
    """(i, j, value): h = f_x g_y - f_y g_x with g = |grad f|^2."""
    jet = sampled_jet(controls, axes, at, {"fx": (1, 0), "fy": (0, 1), "fxx": (2, 0), "fxy": (1, 1), "fyy": (0, 2)})
    gx = 2 * (F.col("fx") * F.col("fxx") + F.col("fy") * F.col("fxy"))
    gy = 2 * (F.col("fx") * F.col("fxy") + F.col("fy") * F.col("fyy"))
    return jet.select("i", "j", (F.col("fx") * gy - F.col("fy") * gx).alias("value"))


def sampled_jacobian(f: DataFrame, g: DataFrame, axes: Axes, at: Sequence[np.ndarray]) -> DataFrame:
    """(i, j, value): f_x g_y - f_y g_x of two models on one grid of parameters."""
    a = sampled_jet(f, axes, at, {"fx": (1, 0), "fy": (0, 1)})
    b = sampled_jet(g, axes, at, {"gx": (1, 0), "gy": (0, 1)})
    return a.join(b, ["i", "j"]).select("i", "j", (F.col("fx") * F.col("gy") - F.col("fy") * F.col("gx")).alias("value"))
