"""Roots on knot spans: all seeds of a batch of spans advance together in NumPy (mapInPandas)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.local import SPAN, Field, Local, jacobian, jacobian_hessian, seeds, span_blocks
from ..functions.spline import AXES, Axes
from .prune import critical_spans

#: Least determinant, distance caps in span diagonals.
DET = 1e-13
NEWTON_CAP, STEP_CAP = 10.0, 5.0


def newton(value, local: Local, which: np.ndarray, x: np.ndarray, eps: float, most: int, cap: float = NEWTON_CAP):
    """Newton iteration of value(which, x) -> (vector, matrix); (converged, x, iterations).

    A seed stops when it is a root, leaves the core box or its span's surroundings, or meets a singular matrix.
    """
    x = x.copy()
    centre, size = (local.lo + local.hi) / 2, np.sqrt(((local.hi - local.lo) ** 2).sum(axis=1))
    good, used = np.zeros(len(x), bool), np.zeros(len(x), int)
    live = np.arange(len(x))
    for step in range(most + 1):
        v, m = value(which[live], x[live])
        done = np.sqrt((v * v).sum(axis=1)) < eps
        good[live[done]] = True
        used[live] = step
        live, v, m = live[~done], v[~done], m[~done]
        if not len(live) or step == most:
            break
        fine = np.abs(np.linalg.det(m)) >= DET
        live, v, m = live[fine], v[fine], m[fine]
        if not len(live):
            break
        x[live] -= np.linalg.solve(m, v[:, :, None])[:, :, 0]
        w = which[live]
        far = np.sqrt(((x[live] - centre[w]) ** 2).sum(axis=1)) > cap * size[w]
        live = live[~far & local.in_core(x[live])]
    return good & local.inside(which, x), x, used


def to_level(field: Field, local: Local, which: np.ndarray, x: np.ndarray, eps: float, most: int, cap: float = STEP_CAP):
    """Gradient steps x -= F / |grad F|^2 grad F until |F| < eps; (converged, x)."""
    x = x.copy()
    centre, size = (local.lo + local.hi) / 2, np.sqrt(((local.hi - local.lo) ** 2).sum(axis=1))
    good = np.zeros(len(x), bool)
    live = np.arange(len(x))
    for step in range(most + 1):
        v, g = field(which[live], x[live])
        done = np.abs(v) < eps
        good[live[done]] = True
        live, v, g = live[~done], v[~done], g[~done]
        if not len(live) or step == most:
            break
        n = (g * g).sum(axis=1)
        fine = n > 1e-300
        live, v, g, n = live[fine], v[fine], g[fine], n[fine]
        x[live] -= (v / n)[:, None] * g
        w = which[live]
        far = np.sqrt(((x[live] - centre[w]) ** 2).sum(axis=1)) > cap * size[w]
        live = live[~far & local.in_core(x[live])]
    return good & local.inside(which, x), x


def distinct_in_span(which: np.ndarray, x: np.ndarray, eps: float) -> np.ndarray:
    """Indices of the first of each group of roots of a span closer than eps."""
    kept: list[int] = []
    of: dict[int, list[int]] = {}
    for k, s in enumerate(which.tolist()):
        own = of.setdefault(s, [])
        if not own or (((x[own] - x[k]) ** 2).sum(axis=1) >= eps * eps).all():
            own.append(k)
            kept.append(k)
    return np.array(kept, int)


def _batches(frames, axes: Axes, names: tuple[str, ...]):
    """Each batch of spans with its control blocks, as Locals."""
    for own in frames:
        if len(own):
            spans = own[list(SPAN[: axes.dims])].to_numpy(np.int64)
            yield own, spans, [Local(axes, spans, own[n]) for n in names]


def _schema(axes: Axes, *more: str) -> str:
    return ", ".join([*(f"{s} long" for s in SPAN[: axes.dims]), *(f"{a} double" for a in AXES[: axes.dims]), *more])


def _rows(axes: Axes, spans: np.ndarray, which: np.ndarray, x: np.ndarray, **more) -> pd.DataFrame:
    return pd.DataFrame({**{s: spans[which, d] for d, s in enumerate(SPAN[: axes.dims])}, **{a: x[:, d] for d, a in enumerate(AXES[: axes.dims])}, **more})


def morse_index(hessian: np.ndarray) -> np.ndarray:
    """Negative eigenvalues of each Hessian; -1 where its determinant vanishes."""
    n = (np.linalg.eigvalsh(hessian) < 0).sum(axis=1)
    return np.where(np.abs(np.linalg.det(hessian)) < DET, -1, n)


def morse_index_2d(fxx: Column, fxy: Column, fyy: Column) -> Column:
    """The same in two dimensions, as an expression."""
    det = fxx * fyy - fxy * fxy
    return F.when(F.abs(det) < DET, -1).when(det < 0, 1).when(fxx < 0, 2).otherwise(0)


def critical_points(controls: DataFrame, axes: Axes, eps: float = 1e-10, most: int = 40, spans: DataFrame | None = None, same: float | None = None) -> DataFrame:
    """(span, x, y, ..., value, morse_index, iterations): Newton on the gradient from p + 1 seeds a dimension of each kept span."""
    kept = span_blocks(critical_spans(controls, axes) if spans is None else spans, controls, axes)
    same = 1e-3 * axes.span_size()[0] if same is None else same

    def run(frames):
        for _, numbers, (f,) in _batches(frames, axes, ("block",)):
            which, x = seeds(f, max(axes.degree) + 1)
            good, x, used = newton(lambda w, p, f=f: (f.gradient(w, p), f.hessian(w, p)), f, which, x, eps, most)
            which, x, used = which[good], x[good], used[good]
            k = distinct_in_span(which, x, same)
            which, x, used = which[k], x[k], used[k]
            if len(x):
                yield _rows(axes, numbers, which, x, value=f.partial(which, x, (0,) * axes.dims), morse_index=morse_index(f.hessian(which, x)), iterations=used)

    found = kept.mapInPandas(run, _schema(axes, "value double", "morse_index int", "iterations int"))
    return unique_roots(found, axes, same)


def unique_roots(found: DataFrame, axes: Axes, eps: float) -> DataFrame:
    """One row of each group of roots closer than eps, across spans; numbered by `id`."""
    from .graph import numbered
    from .spatial import eps_distinct

    held = numbered(found, [*AXES[: axes.dims], *SPAN[: axes.dims]], "id")
    return eps_distinct(held, eps, AXES[: axes.dims])


def level_roots(controls: DataFrame, axes: Axes, spans: DataFrame, kind: str = "level", level: float = 0.0, other: DataFrame | None = None, eps: float = 1e-10, most: int | None = None, same: float | None = None) -> DataFrame:
    """(span, x, y): points of F = 0 in each span, from a grid of seeds.

    kind: level (f = level; p + 3 seeds), ridge (h(f, |grad f|^2) = 0; 3p + 2 seeds) or jacobi (h(f, g) = 0; 2p + 2).
    """
    rows = span_blocks(spans, controls, axes)
    if kind == "jacobi":
        rows = span_blocks(rows, other, axes, "block2")
    p = max(axes.degree)
    per, left, right, shape, steps = {"level": (p + 3, 0.0, 1.0, "ends", 30), "ridge": (3 * p + 2, 0.01, 0.99, "ends", 100), "jacobi": (2 * p + 2, 0.01, 0.99, "ends", 30)}[kind]
    same = 0.5 * axes.span_size()[0] / 8 if same is None else same

    def run(frames):
        for _, numbers, locals_ in _batches(frames, axes, ("block", "block2") if kind == "jacobi" else ("block",)):
            field = Field(kind, locals_[0], locals_[-1], level)
            which, x = seeds(locals_[0], per, left, right, shape)
            good, x = to_level(field, locals_[0], which, x, eps, most or steps)
            which, x = which[good], x[good]
            k = distinct_in_span(which, x, same)
            if len(k):
                yield _rows(axes, numbers, which[k], x[k])

    return rows.mapInPandas(run, _schema(axes))


def jacobi_critical_points(controls: DataFrame, other: DataFrame, axes: Axes, spans: DataFrame, eps: float = 1e-10, most: int = 70, residual: float = 1e-6) -> DataFrame:
    """Critical points of h(f, g) with |h| < residual: (span, x, y, h)."""
    rows = span_blocks(span_blocks(spans, controls, axes), other, axes, "block2")

    def run(frames):
        for _, numbers, (f, g) in _batches(frames, axes, ("block", "block2")):

            def value(w, p, f=f, g=g):
                a, b = f.jet(w, p, 3), g.jet(w, p, 3)
                return jacobian(a, b)[1], jacobian_hessian(a, b)

            which, x = seeds(f, 2 * max(axes.degree) + 2)
            good, x, _ = newton(value, f, which, x, eps, most)
            which, x = which[good], x[good]
            k = distinct_in_span(which, x, 1e-3 * axes.span_size()[0])
            which, x = which[k], x[k]
            if len(x):
                yield _rows(axes, numbers, which, x, h=jacobian(f.jet(which, x, 2), g.jet(which, x, 2))[0])

    found = rows.mapInPandas(run, _schema(axes, "h double")).where(F.abs("h") < residual)
    return unique_roots(found, axes, 1e-3 * axes.span_size()[0])


def boundary_roots(controls: DataFrame, axes: Axes, spans: DataFrame, eps: float = 1e-10, most: int = 40) -> DataFrame:
    """Points of f_x = f_y = 0 on the faces of the space-time box (all but the last time), for tracking: (span, x, y, t).

    On a face of fixed x or y the free dimensions are the other one and time; on the first time, x and y.
    """
    rows = span_blocks(spans, controls, axes)
    p = max(axes.degree)

    def run(frames):
        for _, numbers, (f,) in _batches(frames, axes, ("block",)):
            for d in range(3):
                for end in (0, 1):
                    if d == 2 and end:
                        continue
                    at_end = np.flatnonzero(numbers[:, d] == (axes.controls[d] - 1 if end else axes.degree[d]))
                    if not len(at_end):
                        continue
                    fixed = axes.maxs[d] if end else axes.mins[d]
                    free = [k for k in range(3) if k != d]
                    which, x = seeds(f, p + 3, kind="left")
                    own = np.isin(which, at_end)
                    which, x = which[own], x[own]
                    x[:, d] = fixed
                    x = np.unique(np.column_stack((which, x)), axis=0)
                    which, x = x[:, 0].astype(int), x[:, 1:]
                    good, x = _on_face(f, which, x, free, eps, most)
                    which, x = which[good], x[good]
                    k = distinct_in_span(which, x, 1e-3 * axes.span_size()[0])
                    if len(k):
                        yield _rows(axes, numbers, which[k], x[k])

    return unique_roots(rows.mapInPandas(run, _schema(axes)), axes, 1e-3 * axes.span_size()[0]).withColumnRenamed("z", "t")


def _on_face(f: Local, which, x, free, eps, most):
    """Newton on (f_x, f_y) in two free dimensions."""

    def value(w, p):
        h = f.hessian(w, p)
        return f.gradient(w, p)[:, :2], h[:, :2, :][:, :, free]

    x = x.copy()
    good = np.zeros(len(x), bool)
    live = np.arange(len(x))
    size = np.sqrt(((f.hi - f.lo) ** 2).sum(axis=1))
    centre = (f.lo + f.hi) / 2
    for step in range(most + 1):
        v, m = value(which[live], x[live])
        done = np.sqrt((v * v).sum(axis=1)) < eps
        good[live[done]] = True
        live, v, m = live[~done], v[~done], m[~done]
        fine = np.abs(np.linalg.det(m)) >= DET
        live, v, m = live[fine], v[fine], m[fine]
        if not len(live) or step == most:
            break
        x[np.ix_(live, free)] -= np.linalg.solve(m, v[:, :, None])[:, :, 0]
        far = np.sqrt(((x[live] - centre[which[live]]) ** 2).sum(axis=1)) > STEP_CAP * size[which[live]]
        live = live[~far & f.in_core(x[live])]
    return good & f.inside(which, x), x


def degenerate_points(controls: DataFrame, axes: Axes, spans: DataFrame, eps: float = 1e-8, most: int = 100) -> DataFrame:
    """Points of (x, y, t) where f_x = f_y = 0 and the spatial Hessian is singular: births and deaths."""
    rows = span_blocks(spans, controls, axes)

    def run(frames):
        for _, numbers, (f,) in _batches(frames, axes, ("block",)):

            def value(w, p, f=f):
                d = lambda a, b, c: f.partial(w, p, (a, b, c))
                fxx, fxy, fyy = d(2, 0, 0), d(1, 1, 0), d(0, 2, 0)
                j = np.stack((fxx * fyy - fxy**2, d(1, 0, 0), d(0, 1, 0)), axis=1)
                third = lambda k: (d(2 + (k == 0), k == 1, k == 2), d(1 + (k == 0), 1 + (k == 1), k == 2), d(k == 0, 2 + (k == 1), k == 2))
                det = [a * fyy + fxx * c - 2 * fxy * b for a, b, c in map(third, range(3))]
                m = np.stack((np.stack(det, axis=1), np.stack((fxx, fxy, d(1, 0, 1)), axis=1), np.stack((fxy, fyy, d(0, 1, 1)), axis=1)), axis=1)
                return j, m

            which, x = seeds(f, max(axes.degree) + 3, kind="left")
            good, x, _ = newton(value, f, which, x, eps, most)
            which, x = which[good], x[good]
            k = distinct_in_span(which, x, 1e-3 * axes.span_size()[0])
            if len(k):
                yield _rows(axes, numbers, which[k], x[k])

    return unique_roots(rows.mapInPandas(run, _schema(axes)), axes, 1e-3 * axes.span_size()[0]).withColumnRenamed("z", "t")
