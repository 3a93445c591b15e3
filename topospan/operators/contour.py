"""Piecewise-linear topology of gridded fields: critical points, level sets, Jacobi sets.

A field is (i, j, x, y, value) on an n x m grid; each cell is split into the triangles (v0, v1, v2)
and (v1, v3, v2) with v1 = (i+1, j), v2 = (i, j+1), v3 = (i+1, j+1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight neighbours, and in order around a vertex the six that triangles join it to.
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
LINK = [(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]


def _spread(field: DataFrame, offsets: list[tuple[int, int]], columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Each vertex's values, sent to the vertices that have it at offset number o: one shuffle, with partial aggregation."""
    at = F.array(*(F.struct(F.lit(k).alias("o"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate([(0, 0), *offsets])))
    by = by or []
    sent = field.select(*by, "i", "j", *columns, F.explode(at).alias("__t")).select(*by, (F.col("i") - F.col("__t.a")).alias("i"), (F.col("j") - F.col("__t.b")).alias("j"), F.col("__t.o").alias("o"), *columns)
    return sent.groupBy(*by, "i", "j").agg(*(F.max(F.when(F.col("o") == k, F.col(c))).alias(f"{c}_{k}") for k in range(len(offsets) + 1) for c in columns))


def discrete_critical_points(field: DataFrame) -> DataFrame:
    """(i, j, type): interior vertices whose value is above (max) or below (min) all eight neighbours, or a saddle.

    A saddle has at least four changes between higher and lower neighbours around it.
    """
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    wide = _spread(field, ring, ["value"]).where(" AND ".join(f"value_{k} IS NOT NULL" for k in range(9)))
    return wide.select("i", "j", _kind([F.col(f"value_{k}") for k in range(1, 9)], F.col("value_0")).alias("type")).where("type IS NOT NULL")


def _kind(ring: list[Column], own: Column) -> Column:
    up = [v > own for v in ring]
    changes = sum(F.when(a != b, 1).otherwise(0) for a, b in zip(up, [*up[1:], up[0]], strict=True))
    every = lambda cs: F.least(*(c.cast("int") for c in cs)) == 1
    return F.when(every([v < own for v in ring]), "max").when(every(up), "min").when(changes >= 4, "saddle")


def pl_critical_points(field: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(i, j, type): interior vertices by the changes of sign in their triangulated link (none: extremum, 4 or more: saddle).

    `by` names the columns of a slice (a time step): all slices are done at once, each for itself. Equal values count as higher where the neighbour stands later in the grid.
    """
    wide = _spread(field, LINK, ["value"], by).where(" AND ".join(f"value_{k} IS NOT NULL" for k in range(7)))
    up = [(F.col(f"value_{k}") > F.col("value_0")) | ((F.col(f"value_{k}") == F.col("value_0")) & F.lit(b > 0 or (b == 0 and a > 0))) for k, (a, b) in enumerate(LINK, 1)]
    changes = sum(F.when(a != b, 1).otherwise(0) for a, b in zip(up, [*up[1:], up[0]], strict=True))
    return wide.select(*(by or []), "i", "j", F.when((changes == 0) & up[0], "min").when(changes == 0, "max").when(changes >= 4, "saddle").alias("type")).where("type IS NOT NULL")


def cells(field: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, c_0 ... c_3): the values at the corners of each whole cell."""
    return _spread(field, [(1, 0), (0, 1), (1, 1)], columns).where(" AND ".join(f"{columns[0]}_{k} IS NOT NULL" for k in range(4)))


def level_set(field: DataFrame, level: float) -> tuple[DataFrame, DataFrame]:
    """Marching triangles: (vid, x, y) of crossings on triangle sides, and (src, dst) of segments.

    A side is named by its first vertex and direction (0 along i, 1 along j, 2 diagonal), in one long.
    """
    wide = cells(field, ["value", "x", "y"])

    def side(a, b, kind, di, dj):
        va, vb = F.col(f"value_{a}"), F.col(f"value_{b}")
        t = (F.lit(level) - va) / (vb - va)
        key = (((F.col("j") + dj) * 2**30 + (F.col("i") + di)) * 4 + kind).cast("long")
        return F.when((va > level) != (vb > level), F.struct(key.alias("vid"), *((F.col(f"{c}_{a}") + t * (F.col(f"{c}_{b}") - F.col(f"{c}_{a}"))).alias(c) for c in ("x", "y"))))

    bottom, left, diagonal, right, top = side(0, 1, 0, 0, 0), side(0, 2, 1, 0, 0), side(1, 2, 2, 0, 0), side(1, 3, 1, 1, 0), side(2, 3, 0, 0, 1)
    triangles = F.array(*(F.array_compact(F.array(*t)) for t in ((bottom, diagonal, left), (right, top, diagonal))))
    crossed = wide.select(F.explode(triangles).alias("s")).where(F.size("s") == 2)
    edges = crossed.select(F.least(F.col("s")[0]["vid"], F.col("s")[1]["vid"]).alias("src"), F.greatest(F.col("s")[0]["vid"], F.col("s")[1]["vid"]).alias("dst"))
    vertices = crossed.select(F.explode("s").alias("v")).groupBy("v.vid").agg(F.first("v.x").alias("x"), F.first("v.y").alias("y"))
    return vertices, edges


def jacobi_field(f: DataFrame, g: DataFrame) -> DataFrame:
    """h = f_x g_y - f_y g_x by central differences, on interior vertices: (i, j, x, y, value)."""
    both = f.select("i", "j", "x", "y", F.col("value").alias("f")).join(g.select("i", "j", F.col("value").alias("g")), ["i", "j"])
    wide = _spread(both, [(1, 0), (-1, 0), (0, 1), (0, -1)], ["f", "g", "x", "y"]).where(" AND ".join(f"f_{k} IS NOT NULL" for k in range(5)))
    dx, dy = F.col("x_1") - F.col("x_2"), F.col("y_3") - F.col("y_4")
    d = lambda c, a, b, h: (F.col(f"{c}_{a}") - F.col(f"{c}_{b}")) / h
    return wide.select("i", "j", F.col("x_0").alias("x"), F.col("y_0").alias("y"), (d("f", 1, 2, dx) * d("g", 3, 4, dy) - d("f", 3, 4, dy) * d("g", 1, 2, dx)).alias("value"))


def nearest_over_time(points: DataFrame, eps: float) -> DataFrame:
    """Links (t, id, next_id) from each critical point to the nearest of its type at t + 1 within eps."""
    from .spatial import _around, _cell

    near = F.transform(_around(2), lambda o: F.zip_with(_cell(("x", "y"), eps), o, lambda p, q: p + q))
    a = points.select("t", "id", "type", "x", "y", _cell(("x", "y"), eps).alias("cell"))
    b = points.select((F.col("t") - 1).alias("t"), F.col("id").alias("next_id"), "type", F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(near).alias("cell"))
    d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    return a.join(b, ["t", "type", "cell"]).withColumn("d2", d2).where(F.col("d2") <= eps * eps).groupBy("t", "id").agg(F.min_by("next_id", F.struct("d2", "next_id")).alias("next_id"))
