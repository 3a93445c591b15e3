"""Sinks: Parquet models, CSV, OBJ, VTK, PLY, matrices. Text files are written by Spark in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spline import Axes


def model(controls: DataFrame, axes: Axes, path: str) -> None:
    """Control points as Parquet, split by model where they carry a model_id, and the axes with their knots as JSON."""
    w = controls.write.mode("overwrite")
    (w.partitionBy("model_id") if "model_id" in controls.columns else w).parquet(f"{path}/controls")
    row = (list(axes.degree), list(axes.controls), [float(x) for x in axes.mins], [float(x) for x in axes.maxs], [k.tolist() for k in axes.knots])
    schema = "degree array<int>, controls array<int>, mins array<double>, maxs array<double>, knots array<array<double>>"
    controls.sparkSession.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{path}/axes")


def roots(points: DataFrame, path: str, eps: float | None = None, value: float | None = None) -> None:
    """Roots (id, x, y) as CSV: one of each group closer than eps, if given, with a constant value, if given."""
    from ..operators.spatial import eps_distinct

    csv((points if eps is None else eps_distinct(points, eps)).drop("id"), path, value)


def snapped_box(mins, maxs, shape, shares) -> list[tuple[float, float]]:
    """The box that shares (a, b) of each axis' range name, moved to the nearest grid nodes."""
    node = lambda s, n: round(s * (n - 1)) / (n - 1)
    return [(lo + node(a, n) * (hi - lo), lo + node(b, n) * (hi - lo)) for lo, hi, n, (a, b) in zip(mins, maxs, shape, shares, strict=True)]


def csv(points: DataFrame, path: str, value: float | None = None) -> None:
    """Points with a header; with a constant column `value` if one is given."""
    (points if value is None else points.withColumn("value", F.lit(value))).write.mode("overwrite").csv(path, header=True)


def _number(c: Column) -> Column:
    return F.format_string("%.15g", c.cast("double"))


def _text(parts: list[DataFrame], path: str) -> None:
    """Lines of (part, n, line), in order of part and n, range-partitioned: file names follow the order."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    out.repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("line").write.mode("overwrite").text(path)


def obj(vertices: DataFrame, edges: DataFrame, path: str, z: bool = True) -> None:
    """`v x y z` and 1-based `l a b` lines; vertices must be numbered from 0 without gaps."""
    v = vertices.select(F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), _number(F.col("x")), _number(F.col("y")), _number(F.col("z") if z else F.lit(0.0))).alias("line"))
    e = edges.select((F.col("src") * 2**31 + F.col("dst")).alias("n"), F.format_string("l %d %d", F.col("src") + 1, F.col("dst") + 1).alias("line"))
    _text([v, e], path)


def edge_types(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A line with the type of each edge, in the order in which `obj` writes them."""
    from ..operators.graph import typed_edges

    t = typed_edges(vertices, edges)
    _text([t.select((F.col("src") * 2**31 + F.col("dst")).alias("n"), F.col("type").cast("string").alias("line"))], path)


def points_obj(points: DataFrame, path: str) -> None:
    """Vertices only."""
    v = points.select(F.monotonically_increasing_id().alias("n"), F.concat_ws(" ", F.lit("v"), *(_number(F.col(c)) for c in points.columns[:3])).alias("line"))
    _text([v], path)


def triangles(n: int, m: int, spark) -> DataFrame:
    """(n, a, b, c): two triangles a cell of an n x m grid, vertices numbered with the first index fastest."""
    cell = spark.range((n - 1) * (m - 1)).select("id", (F.col("id") % (n - 1)).alias("i"), F.floor(F.col("id") / (n - 1)).alias("j"))
    v0 = F.col("j") * n + F.col("i")
    both = F.array(F.struct(v0.alias("a"), (v0 + 1).alias("b"), (v0 + n).alias("c")), F.struct((v0 + 1).alias("a"), (v0 + n + 1).alias("b"), (v0 + n).alias("c")))
    return cell.select("id", F.posexplode(both).alias("k", "t")).select((F.col("id") * 2 + F.col("k")).alias("n"), "t.a", "t.b", "t.c")


def ply(field: DataFrame, n: int, m: int, path: str) -> None:
    """The triangulated height field as an ASCII PLY."""
    head = field.sparkSession.createDataFrame([(k, x) for k, x in enumerate(["ply", "format ascii 1.0", f"element vertex {n * m}", *(f"property float {c}" for c in "xyz"), f"element face {2 * (n - 1) * (m - 1)}", "property list uchar int vertex_indices", "end_header"])], "n long, line string")
    v = field.select((F.col("j") * n + F.col("i")).alias("n"), F.concat_ws(" ", *(_number(F.col(c)) for c in ("x", "y", "value"))).alias("line"))
    t = triangles(n, m, field.sparkSession).select("n", F.format_string("3 %d %d %d", "a", "b", "c").alias("line"))
    _text([head, v, t], path)


def vtk_mesh(field: DataFrame, n: int, m: int, path: str) -> None:
    """A sampled function as a legacy VTK triangle mesh."""
    make = lambda *lines: field.sparkSession.createDataFrame([(k, x) for k, x in enumerate(lines)], "n long, line string")
    cells = 2 * (n - 1) * (m - 1)
    v = field.select((F.col("j") * n + F.col("i")).alias("n"), F.concat_ws(" ", *(_number(F.col(c)) for c in ("x", "y", "value"))).alias("line"))
    s = field.select((F.col("j") * n + F.col("i")).alias("n"), _number(F.col("value")).alias("line"))
    t = triangles(n, m, field.sparkSession).select("n", F.format_string("3 %d %d %d", "a", "b", "c").alias("line"))
    kinds = field.sparkSession.range(cells).select(F.col("id").alias("n"), F.lit("5").alias("line"))
    _text([make("# vtk DataFile Version 3.0", "field", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n * m} double"), v, make(f"CELLS {cells} {4 * cells}"), t, make(f"CELL_TYPES {cells}"), kinds, make(f"POINT_DATA {n * m}", "SCALARS value double 1", "LOOKUP_TABLE default"), s], path)


def vtk_points(points: DataFrame, path: str) -> None:
    """Points with a value as a legacy VTK file."""
    from ..operators.graph import numbered

    p = numbered(points, ["x", "y"], "n")
    total = p.count()
    make = lambda *lines: points.sparkSession.createDataFrame([(k, x) for k, x in enumerate(lines)], "n long, line string")
    z = F.col("z") if "z" in points.columns else F.lit(0.0)
    _text([make("# vtk DataFile Version 3.0", "points", "ASCII", "DATASET POLYDATA", f"POINTS {total} double"), p.select("n", F.concat_ws(" ", _number(F.col("x")), _number(F.col("y")), _number(z)).alias("line")), make(f"POINT_DATA {total}", "SCALARS value double 1", "LOOKUP_TABLE default"), p.select("n", _number(F.col("value")).alias("line"))], path)


def rectilinear_vtk(field: DataFrame, n: int, m: int, path: str) -> None:
    """A regular grid as a legacy VTK rectilinear mesh."""
    make = lambda *lines: field.sparkSession.createDataFrame([(k, x) for k, x in enumerate(lines)], "n long, line string")
    axis = lambda c, i, o: field.where(F.col(o) == 0).select(F.col(i).alias("n"), _number(F.col(c)).alias("line"))
    s = field.select((F.col("j") * n + F.col("i")).alias("n"), _number(F.col("value")).alias("line"))
    _text([make("# vtk DataFile Version 3.0", "field", "ASCII", "DATASET RECTILINEAR_GRID", f"DIMENSIONS {n} {m} 1", f"X_COORDINATES {n} double"), axis("x", "i", "j"), make(f"Y_COORDINATES {m} double"), axis("y", "j", "i"), make("Z_COORDINATES 1 double", "0", f"POINT_DATA {n * m}", "SCALARS value double 1", "LOOKUP_TABLE default"), s], path)


def matrix_bytes(rows: list[np.ndarray]) -> bytes:
    """Dense matrices in the binary layout that `files.matrices` reads; for what fits the driver."""
    out = [np.int32(len(rows)).tobytes()]
    for a in rows:
        out += [np.array(a.shape, "<u8").tobytes(), np.asfortranarray(a, "<f8").tobytes(order="F")]
    return b"".join(out)


def time_slices(series: DataFrame, times: list[int]) -> DataFrame:
    """One column a time step: (i, j, t_0, t_1, ...)."""
    return series.groupBy("i", "j").pivot("t", times).agg(F.first("value")).select("i", "j", *(F.col(str(t)).alias(f"t_{t}") for t in times))
