"""Files of the supported formats as DataFrames: raw bricks, vector volumes, matrices, OBJ, text, CSV.

Raw binaries are read through Spark's binaryFile source, so any store that Spark reads will do; a
raw volume too large for one row is best given as one file a slab (see `series`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spline import Axes

AXES, INDEX = ("x", "y", "z", "t"), ("i", "j", "k", "m")


def _volume(files: DataFrame, shape: Sequence[int], vector: int, dtype: str, order: str, starts: Sequence[int] | None, counts: Sequence[int] | None, missing: float | None, scale: float) -> DataFrame:
    """(path, i, j, ..., value [, value_1, ...]) of raw files; the sub-box is cut before rows are made."""
    names = [*INDEX[: len(shape)], "value", *(f"value_{k}" for k in range(1, vector))]
    starts = list(starts or [0] * len(shape))
    counts = list(counts or [n - s for n, s in zip(shape, starts, strict=True)])

    def run(frames):
        for own in frames:
            for path, raw in zip(own["path"], own["content"], strict=True):
                a = np.frombuffer(raw, np.dtype(dtype), int(np.prod(shape)) * vector).reshape((*shape[::-1], vector) if order == "F" else (*shape, vector))
                if order == "F":  # the first index is fastest
                    a = a.transpose(*range(len(shape) - 1, -1, -1), len(shape))
                a = a[tuple(slice(s, s + n) for s, n in zip(starts, counts, strict=True))].astype(float) * scale
                if missing is not None:
                    a = np.where(np.isclose(a, missing * scale), np.nan, a)
                grid = np.indices(counts)
                out = {n: (g + s).ravel() for n, g, s in zip(INDEX, grid, starts, strict=False)}
                out |= {n: a[..., k].ravel() for k, n in enumerate(names[len(shape) :])}
                yield pd.DataFrame({"path": path, **out})

    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{n} {'long' if n in INDEX else 'double'}" for n in names))


def raw(spark: SparkSession, path: str, shape: Sequence[int], vector: int = 1, dtype: str = "<f4", order: str = "F", starts: Sequence[int] | None = None, counts: Sequence[int] | None = None, missing: float | None = None) -> DataFrame:
    """A raw binary brick of values: scalar or vector, C or Fortran order, any NumPy dtype, whole or a sub-box."""
    return _volume(spark.read.format("binaryFile").load(path), shape, vector, dtype, order, starts, counts, missing, 1.0).drop("path")


def series(spark: SparkSession, paths: Sequence[str], shape: Sequence[int], vector: int = 1, dtype: str = "<f4", order: str = "F", scale: float = 1.0) -> DataFrame:
    """One file a time step: adds m, the place of the file in the list."""
    times = spark.createDataFrame([(p.rsplit("/", 1)[-1], k) for k, p in enumerate(paths)], "name string, m long")
    rows = _volume(spark.read.format("binaryFile").load(list(paths)), shape, vector, dtype, order, None, None, None, scale)
    return rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(times), "name").drop("name", "path")  # a list of files


def series_of(spark: SparkSession, list_path: str, shape: Sequence[int], **options) -> DataFrame:
    """The series whose files a list file names, one a line, beside it or with a scheme or root of their own."""
    base = list_path.rsplit("/", 1)[0]
    names = [r.value.strip() for r in spark.read.text(list_path).toLocalIterator() if r.value.strip()]
    return series(spark, [n if "/" in n else f"{base}/{n}" for n in names], shape, **options)


def magnitude(df: DataFrame, vector: int = 3) -> DataFrame:
    """The norm of the components as `value`."""
    parts = ["value", *(f"value_{k}" for k in range(1, vector))]
    return df.withColumn("value", F.sqrt(sum(F.col(p) * F.col(p) for p in parts))).drop(*parts[1:])


def centre_slice(spark: SparkSession, path: str, shape: Sequence[int], keep: int, dtype: str = "<f4") -> DataFrame:
    """Magnitudes of a 3-vector volume on its first `keep` dimensions, at the centre of the others."""
    starts = [0] * keep + [n // 2 for n in shape[keep:]]
    counts = [*shape[:keep], *[1] * (len(shape) - keep)]
    return magnitude(raw(spark, path, shape, 3, dtype, starts=starts, counts=counts)).drop(*INDEX[keep : len(shape)])


def placed(df: DataFrame, dims: int, mins: Sequence[float] | None = None, maxs: Sequence[float] | None = None, shape: Sequence[int] | None = None) -> DataFrame:
    """Adds coordinates: the indices themselves, or evenly spaced in a range."""
    out = {}
    for d in range(dims):
        i = F.col(INDEX[d]).cast("double")
        out[AXES[d]] = i if mins is None else mins[d] + i * ((maxs[d] - mins[d]) / max(shape[d] - 1, 1))
    return df.withColumns(out)


def unstructured(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """White-space separated numbers: coordinates, then values."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where("trim(value) != ''").select(parts.alias("p"))
    return rows.select(*(F.col("p")[d].cast("double").alias(AXES[d]) for d in range(dims)), F.col("p")[dims].cast("double").alias("value"))


def points_bin(spark: SparkSession, path: str, columns: int = 3, keep: int = 2) -> DataFrame:
    """Rows of float64; the first `keep` columns."""

    def run(frames):
        for own in frames:
            for content in own["content"]:
                a = np.frombuffer(content, np.float64).reshape(-1, columns)[:, :keep]
                yield pd.DataFrame(a, columns=list(AXES[:keep]))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} double" for c in AXES[:keep]))


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """(matrix, row, col, value) of files of dense matrices: a count, then rows, columns and values by column."""

    def run(frames):
        for own in frames:
            for content in own["content"]:
                at, n = 4, int(np.frombuffer(content, "<i4", 1)[0])
                for k in range(n):
                    r, c = (int(x) for x in np.frombuffer(content, "<u8", 2, at))
                    a = np.frombuffer(content, "<f8", r * c, at + 16)
                    at += 16 + 8 * r * c
                    yield pd.DataFrame({"matrix": k, "row": np.tile(np.arange(r), c), "col": np.repeat(np.arange(c), r), "value": a})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "matrix int, row long, col long, value double")


def critical_points(points: DataFrame, level: float | None = None, threshold: float = 0.0) -> DataFrame:
    """Critical points, of one level only if it is given: a filter that reaches the Parquet scan."""
    return points if level is None else points.where((F.col("value") > level - threshold) & (F.col("value") < level + threshold))


def obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vid, x, y, z) and (src, dst) of a Wavefront file; ids count vertices from 0 in file order."""
    from ..operators.graph import numbered

    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("p"))
    vertices = numbered(lines.where(F.col("p")[0] == "v"), ["line"]).select("vid", *(F.col("p")[k].cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))))
    path_ = F.transform(F.slice("p", 2, F.size("p") - 1), lambda s: F.split(s, "/")[0].cast("long") - 1)
    sides = lines.where(F.col("p")[0].isin("l", "f")).select(F.col("p")[0].alias("kind"), path_.alias("q"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("q") - F.when(F.col("kind") == "f", 1).otherwise(2)), lambda k: F.struct(F.get("q", k).alias("src"), F.get("q", (k + 1) % F.size("q")).alias("dst")))
    return vertices, sides.select(F.explode(pairs).alias("e")).select("e.src", "e.dst")


def csv_points(spark: SparkSession, path: str, dims: int = 2) -> DataFrame:
    """(x0 ..., value, index) of a point file with a header."""
    schema = ", ".join([*(f"x{d} double" for d in range(dims)), "value double", "index double"])
    return spark.read.csv(path, header=True, schema=schema)


def baseline_points(spark: SparkSession, path: str) -> DataFrame:
    """Discrete critical points of another tool, without those on the boundary or of a type over 3."""
    rows = spark.read.csv(path, header=True)
    places = (F.col(f"Position{c}").cast("double").alias(c.lower()) for c in "XYZ")
    return rows.where((F.col("CriticalType").cast("int") < 4) & (F.col("IsOnBoundary").cast("int") == 0)).select(F.col("CriticalType").cast("int").alias("type"), *places)


def model(spark: SparkSession, path: str) -> tuple[Axes, DataFrame]:
    """The axes and the control points that `sinks.model` wrote."""
    row = spark.read.json(f"{path}/axes").first()
    axes = Axes(list(row.degree), list(row.controls), list(row.mins), list(row.maxs), [np.array(k) for k in row.knots])
    return axes, spark.read.parquet(f"{path}/controls")


def fill_missing(field: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Replaces NaN by the mean of the known values of the 3 x 3 neighbourhood, until none is left that has any."""
    from ..operators.contour import EIGHT
    from ..operators.tables import written

    held = written(field.select("i", "j", F.when(F.isnan("value"), None).otherwise(F.col("value")).alias("value")), "fill")
    left = held.df.where("value IS NULL").count()
    for _ in range(most_rounds):
        if not left:
            break
        at = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EIGHT))
        sent = held.df.where("value IS NOT NULL").select("i", "j", "value", F.explode(at).alias("o")).select((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), "value")
        means = sent.join(held.df.where("value IS NULL").select("i", "j"), ["i", "j"]).groupBy("i", "j").agg(F.avg("value").alias("mean"))
        new = written(held.df.join(means, ["i", "j"], "left").select("i", "j", F.coalesce("value", "mean").alias("value")), "fill")
        held.drop()
        held = new
        now = held.df.where("value IS NULL").count()
        if now == left:
            break
        left = now
    return held.df


def box(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points inside a box, borders included."""
    for c, (a, b) in bounds.items():
        points = points.where(F.col(c).between(a, b))
    return points


def clipped(segments: DataFrame, planes: Sequence[tuple[Sequence[float], Sequence[float]]]) -> DataFrame:
    """Segments (x0, y0, x1, y1, ...) cut by planes (origin, normal): what lies on the side that each normal points away from."""
    first, last, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for origin, normal in planes:
        d0, d1 = (sum((F.col(f"{c}{e}") - float(o)) * float(n) for c, o, n in zip("xy", origin, normal, strict=True)) for e in (0, 1))
        at = d0 / (d0 - d1)
        out = out | ((d0 > 0) & (d1 > 0))
        first.append(F.when((d0 > 0) & (d1 <= 0), at).otherwise(0.0))
        last.append(F.when((d0 <= 0) & (d1 > 0), at).otherwise(1.0))
    ends = {"0": F.greatest(*first) if planes else first[0], "1": F.least(*last) if planes else last[0]}
    place = lambda c, e: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * ends[e]
    return segments.where(~out & (ends["0"] <= ends["1"])).withColumns({f"{c}{e}": place(c, e) for c in "xy" for e in "01"})


def clamped(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points moved to the nearest place of a box."""
    return points.withColumns({c: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.col(c))) for c, (a, b) in bounds.items()})


def linear_index(index: Sequence[Column], shape: Sequence[int], first_fastest: bool = True) -> Column:
    """The number of an index tuple."""
    pairs = list(zip(index, shape, strict=True))
    out = F.lit(0).cast("long")
    for i, n in reversed(pairs) if first_fastest else pairs:
        out = out * n + i
    return out


def unlinear_index(number: Column, shape: Sequence[int], first_fastest: bool = True) -> list[Column]:
    out, step = [], 1
    for n in shape if first_fastest else reversed(shape):
        out.append(F.floor(number / step) % n)
        step *= n
    return out if first_fastest else out[::-1]


def ordered(df: DataFrame, by: str) -> DataFrame:
    """Row numbers of a small, sequential table."""
    return df.withColumn("n", F.row_number().over(W.orderBy(by)) - 1)
