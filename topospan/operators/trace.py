"""Curves F = 0 traced inside knot spans (applyInPandas by span), and their stitching into a graph.

Inside a span every seed is followed both ways with classic Runge-Kutta steps along the level
tangent and corrected back to the level; a curve ends where it leaves its span, stalls or closes.
Copies (several seeds on one curve) go by a distance test. Stitching is joins: ends meet critical
points and ends of the 3 x 3 spans around, nearest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.local import Field, Local, span_blocks
from ..functions.spline import Axes
from .spatial import _around, _cell

#: Fixed values.
CLOSING, MAX_STEPS, CORRECTIONS = 1.21, 5000, 30
RIDGE, VALLEY, PSEUDO_RIDGE, PSEUDO_VALLEY, CRITICAL = range(5)


def _tangent(field: Field, which, x, sign):
    _, g = field(which, x)
    n = np.sqrt((g * g).sum(axis=1))
    good = n > 1e-12
    n = np.where(good, n, 1)
    return np.stack((sign * g[:, 1] / n, -sign * g[:, 0] / n), axis=1), good


def _step(field: Field, which, x, h, sign):
    k1, a = _tangent(field, which, x, sign)
    k2, b = _tangent(field, which, x + h / 2 * k1, sign)
    k3, c = _tangent(field, which, x + h / 2 * k2, sign)
    k4, d = _tangent(field, which, x + h * k3, sign)
    return x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), a & b & c & d


def _corrected(field: Field, which, x, eps):
    """Points moved back to F = 0 along the gradient; (x, whether |F| < eps)."""
    x = x.copy()
    good = np.zeros(len(x), bool)
    live = np.arange(len(x))
    for _ in range(CORRECTIONS):
        v, g = field(which[live], x[live])
        done = np.abs(v) < eps
        good[live[done]] = True
        live, v, g = live[~done], v[~done], g[~done]
        n = (g * g).sum(axis=1)
        live, v, g, n = live[n > 1e-300], v[n > 1e-300], g[n > 1e-300], n[n > 1e-300]
        if not len(live):
            break
        x[live] -= (v / n)[:, None] * g
    return x, good


def follow(field: Field, local: Local, which: np.ndarray, start: np.ndarray, h: float, eps: float, sign: float) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Paths from each start, all advanced together; (points after the start, closed)."""
    paths: list[list[np.ndarray]] = [[] for _ in range(len(start))]
    closed = np.zeros(len(start), bool)
    x, live = start.copy(), np.arange(len(start))
    first = np.full(len(start), np.inf)
    for step in range(MAX_STEPS):
        if not len(live):
            break
        w, old = which[live], x[live]
        ended = np.ones(len(live), bool)
        new = old.copy()
        for share in (1.0, 0.5, 0.1):  # shorter steps before leaving the span
            y, ok = _step(field, w[ended], old[ended], h * share, sign)
            y, on = _corrected(field, w[ended], y, eps)
            ok = ok & on & local.inside(w[ended], y) & (((y - old[ended]) ** 2).sum(axis=1) > (0.1 * h * share) ** 2)
            at = np.flatnonzero(ended)[ok]
            new[at] = y[ok]
            ended[at] = False
        moved = ~ended
        own = live[moved]
        x[own] = new[moved]
        length = ((new - old)[moved] ** 2).sum(axis=1)
        if step == 0:
            first[own] = length
        back = ((x[own] - start[own]) ** 2).sum(axis=1) < CLOSING * first[own]
        shut = back if step > 2 else np.zeros(len(own), bool)
        for k, p in zip(own.tolist(), x[own], strict=True):
            paths[k].append(p.copy())
        closed[own[shut]] = True
        live = own[~shut]
    return paths, closed


def curves(field: Field, local: Local, which: np.ndarray, start: np.ndarray, h: float, eps: float) -> list[tuple[int, bool, np.ndarray]]:
    """(span, closed, points) of each distinct curve through the starts.

    A start on a curve already traced (closer than h / 2 to a side of it) is a copy.
    """
    ahead, closed = follow(field, local, which, start, h, eps, 1.0)
    behind, _ = follow(field, local, which[~closed], start[~closed], h, eps, -1.0)
    back = iter(behind)
    out: list[tuple[int, bool, np.ndarray]] = []
    for k in range(len(start)):
        points = [start[k], *ahead[k]] if closed[k] else [*reversed(next(back)), start[k], *ahead[k]]
        out.append((int(which[k]), bool(closed[k]), np.array(points)))
    out.sort(key=lambda c: (c[0], not c[1], -len(c[2]), *c[2][0]))
    kept: dict[int, list[tuple[bool, np.ndarray]]] = {}
    for span, shut, points in out:
        own = kept.setdefault(span, [])
        middle = points[len(points) // 2]
        if not any(_near(middle, other, c, 0.5 * h) for c, other in own):
            own.append((shut, points))
    return [(s, c, p) for s, own in kept.items() for c, p in own]


def _near(point: np.ndarray, line: np.ndarray, closed: bool, eps: float) -> bool:
    """Whether a point is closer than eps to a polyline."""
    if len(line) == 1:
        return bool(((line[0] - point) ** 2).sum() < eps * eps)
    a = line if closed else line[:-1]
    b = np.roll(line, -1, axis=0) if closed else line[1:]
    d = b - a
    t = np.clip(((point - a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return bool((((a + t[:, None] * d - point) ** 2).sum(axis=1) < eps * eps).any())


def classify(local: Local, which: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Ridge, valley or pseudo ones, by the curvature of f and of |grad f|^2 across the gradient."""
    from ..functions.local import steepness

    f = local.jet(which, x, 3)
    g = steepness(f)
    v = np.stack((-f[0, 1], f[1, 0]), axis=1)
    bend = lambda j: j[2, 0] * v[:, 0] ** 2 + 2 * j[1, 1] * v[:, 0] * v[:, 1] + j[0, 2] * v[:, 1] ** 2
    a, b = bend(f), bend(g)
    return np.where(a < 0, np.where(b < 0, PSEUDO_RIDGE, RIDGE), np.where(b < 0, PSEUDO_VALLEY, VALLEY))


TRACE = "si long, sj long, trace_id int, closed boolean, seq int, x double, y double, value double, residual double, type int"


def trace(roots: DataFrame, controls: DataFrame, axes: Axes, kind: str = "level", level: float = 0.0, other: DataFrame | None = None, step: float | None = None, eps: float = 1e-10) -> DataFrame:
    """Points of the curves through the roots (si, sj, x, y) of each span: trace_id and seq within the span.

    step defaults to an eighth of the least knot span; type is the ridge class for `ridge`.
    """
    h = axes.span_size()[0] / 8 if step is None else step
    grouped = roots.groupBy("si", "sj").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("starts"))
    rows = span_blocks(grouped, controls, axes)
    if kind == "jacobi":
        rows = span_blocks(rows, other, axes, "block2")

    def run(frames):
        for own in frames:
            if not len(own):
                continue
            numbers = own[["si", "sj"]].to_numpy(np.int64)
            f = Local(axes, numbers, own["block"])
            g = Local(axes, numbers, own["block2"]) if kind == "jacobi" else None
            field = Field(kind, f, g, level)
            which = np.repeat(np.arange(len(own)), own["starts"].map(len))
            start = np.array([[p["x"], p["y"]] for s in own["starts"] for p in s])
            number: dict[int, int] = {}
            for span, closed, points in curves(field, f, which, start, h, eps):
                at = np.full(len(points), span)
                number[span] = number.get(span, -1) + 1
                yield pd.DataFrame({"si": numbers[span, 0], "sj": numbers[span, 1], "trace_id": number[span], "closed": closed, "seq": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1], "value": f.partial(at, points, (0, 0)), "residual": np.abs(field(at, points)[0]), "type": classify(f, at, points) if kind == "ridge" else 0})

    return rows.mapInPandas(run, TRACE)


def stitch(points: DataFrame, criticals: DataFrame | None, step: float, gamma: float = 2.0, angle: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the graph of traced points and critical points (x, y).

    Consecutive points are joined and closed traces close. An end is joined to the nearest critical
    point within gamma steps (a trace that passes one within a step, without an end there, is joined
    to it by its nearest point), or else to the nearest end of another trace; a trace whose two ends are
    still free closes if they are within a step. Of ends that reach a critical point from within `angle`
    degrees of a nearer one, the nearer stays.
    """
    from .graph import numbered
    from .tables import written

    trace_key = ["si", "sj", "trace_id"]
    v = numbered(points, [*trace_key, "seq"])
    whole = W.partitionBy(*trace_key)
    v = written(v.withColumns({"n": F.count("*").over(whole), "next": F.lead("vid").over(whole.orderBy("seq")), "first": F.min("vid").over(whole), "last": F.max("vid").over(whole)}), "stitch").df
    along = v.where("next IS NOT NULL").select(F.col("vid").alias("src"), F.col("next").alias("dst"))
    loops = v.where("closed AND vid = last AND n > 2").select(F.col("first").alias("src"), F.col("vid").alias("dst"))
    ends = v.where("NOT closed AND (vid = first OR vid = last)").select("vid", "x", "y", F.col("first").alias("trace"), "n")
    reach = gamma * step
    cell = lambda df, *keep: df.select(*keep, "x", "y", _cell(("x", "y"), reach).alias("cell"))
    wide = F.transform(_around(2), lambda o: F.zip_with(_cell(("x", "y"), reach), o, lambda p, q: p + q))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    vertices = v.select("vid", "x", "y", F.col("value").alias("z"), "type")
    made = along.unionByName(loops)
    free = ends
    if criticals is not None:
        top = v.agg(F.coalesce(F.max("vid"), F.lit(-1))).first()[0] + 1
        c = written(numbered(criticals.select("x", "y", *(["value"] if "value" in criticals.columns else [])), ["x", "y"], "cid").withColumn("vid", F.col("cid") + top), "stitch-critical").df
        own = cell(ends, "vid", "trace").join(c.select(F.col("vid").alias("cp"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(wide).alias("cell")), "cell").withColumn("d2", d2).where(F.col("d2") <= reach * reach)
        hit = own.withColumn("k", F.row_number().over(W.partitionBy("vid").orderBy("d2", "cp"))).where("k = 1").withColumn("k", F.row_number().over(W.partitionBy("trace", "cp").orderBy("d2", "vid"))).where("k = 1")
        hit = written(_spread_out(hit, angle), "stitch-hits").df
        made = made.unionByName(hit.select(F.col("vid").alias("src"), F.col("cp").alias("dst")))
        passing = cell(v, "vid", F.col("first").alias("trace")).join(c.select(F.col("vid").alias("cp"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(wide).alias("cell")), "cell").withColumn("d2", d2).where(F.col("d2") <= step * step)
        passing = passing.groupBy("trace", "cp").agg(F.min_by("vid", F.struct("d2", "vid")).alias("vid")).join(own.select("trace", "cp").distinct(), ["trace", "cp"], "left_anti")
        made = made.unionByName(passing.select(F.col("vid").alias("src"), F.col("cp").alias("dst")))
        vertices = vertices.unionByName(c.select("vid", "x", "y", (F.col("value") if "value" in c.columns else F.lit(0.0)).alias("z"), F.lit(CRITICAL).alias("type")))
        free = ends.join(own.select("vid").distinct(), "vid", "left_anti")
    links = cell(free, "vid", "trace").join(free.select(F.col("vid").alias("to"), F.col("trace").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(wide).alias("cell")), "cell").where("trace != other").withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    best = written(links.withColumn("k", F.row_number().over(W.partitionBy("vid").orderBy("d2", "to"))).where("k = 1").select("vid", "to"), "stitch-links").df
    free = free.join(best.select("vid").union(best.select("to")), "vid", "left_anti")
    itself = free.alias("a").join(free.alias("b"), "trace").where("a.vid < b.vid AND a.n > 2").where(((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2) < step * step).select(F.col("a.vid").alias("src"), F.col("b.vid").alias("dst"))
    made = made.unionByName(itself).unionByName(best.select(F.least("vid", "to").alias("src"), F.greatest("vid", "to").alias("dst")))
    return vertices, made.distinct()


def _spread_out(hits: DataFrame, angle: float) -> DataFrame:
    """Per critical point, drops ends within `angle` degrees of a nearer kept one. A point's ends are those within a few steps."""
    limit = np.cos(np.radians(angle))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["d2", "vid"])
        kept, way = [], []
        for r in own.itertuples():
            d = np.array((r.x - r.ox, r.y - r.oy))
            n = np.sqrt((d * d).sum())
            if n == 0 or all((d / n * w).sum() < limit for w in way):
                kept.append((int(r.vid), int(r.cp)))
                if n > 0:
                    way.append(d / n)
        return pd.DataFrame(kept, columns=["vid", "cp"])

    return hits.select("vid", "cp", "d2", "x", "y", "ox", "oy").groupBy("cp").applyInPandas(run, "vid long, cp long")


def residual_summary(points: DataFrame) -> DataFrame:
    """One row: least, largest, mean |F| of traced points, and their number."""
    return points.agg(F.min("residual").alias("least"), F.max("residual").alias("largest"), F.avg("residual").alias("mean"), F.count("*").alias("n"))
