"""Knot spans: their table, the convex-hull filter, sub-boxes and boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spline import INDEX, Axes, derivative_net

SPAN = ("si", "sj", "sk", "sm")
#: Fixed value: slack of the hull test.
HULL = 1e-5


def all_spans(spark: SparkSession, axes: Axes) -> DataFrame:
    """(si, sj, ..., span_id, lo_0, hi_0, ...): each span with its number (first index fastest) and bounds (uniform knots)."""
    out, total = None, 1
    for d in range(axes.dims):
        total *= axes.spans(d)
    out = spark.range(total).withColumnRenamed("id", "span_id")
    step = 1
    for d in range(axes.dims):
        n = axes.spans(d)
        out = out.withColumn(SPAN[d], F.expr(f"(span_id div {step}L) % {n}L + {axes.degree[d]}L"))
        size = axes.range(d) / n
        out = out.withColumns({f"lo_{d}": axes.mins[d] + (F.col(SPAN[d]) - axes.degree[d]) * size, f"hi_{d}": axes.mins[d] + (F.col(SPAN[d]) - axes.degree[d] + 1) * size})
        step *= n
    return out


def _block_bounds(net: DataFrame, sizes: Sequence[int], low: str = "c", high: str = "c") -> DataFrame:
    """Least and largest control point of each block of `sizes` points per dimension, one window a dimension.

    A block keeps its first index; those that would leave the net go.
    """
    names = INDEX[: len(sizes)]
    out = net.select(*names, F.col(low).alias("cmin"), F.col(high).alias("cmax"))
    for d, size in enumerate(sizes):
        line = W.partitionBy(*(x for x in names if x != names[d])).orderBy(names[d]).rowsBetween(0, size - 1)
        out = out.withColumns({"cmin": F.min("cmin").over(line), "cmax": F.max("cmax").over(line), "__n": F.count("*").over(line)}).where(F.col("__n") == size).drop("__n")
    return out


def hull_bounds(controls: DataFrame, axes: Axes, d: int | None = None) -> DataFrame:
    """(si, sj, ..., cmin, cmax): bounds of the model, or of its derivative in dimension d, in each span."""
    net = controls if d is None else derivative_net(controls, axes, d)
    sizes = [axes.degree[k] + (k != d) for k in range(axes.dims)]
    out = _block_bounds(net, sizes)
    return out.select(*((F.col(INDEX[k]) + axes.degree[k]).alias(SPAN[k]) for k in range(axes.dims)), "cmin", "cmax")


def critical_spans(controls: DataFrame, axes: Axes, first_dims: int | None = None, slack: float = HULL) -> DataFrame:
    """Spans in which every one of the first `first_dims` derivatives may vanish: a critical point can only be there."""
    dims = first_dims or axes.dims
    spans = list(SPAN[: axes.dims])
    kept = None
    for d in range(dims):
        own = hull_bounds(controls, axes, d).where((F.col("cmax") >= -slack) & (F.col("cmin") <= slack)).select(*spans)
        kept = own if kept is None else kept.unionByName(own)
    return kept.groupBy(*spans).agg(F.count("*").alias("n")).where(F.col("n") == dims).drop("n")


def level_spans(controls: DataFrame, axes: Axes, level: float, slack: float = HULL) -> DataFrame:
    """Spans in which the model may take the level."""
    return hull_bounds(controls, axes).where((F.col("cmin") <= level + slack) & (F.col("cmax") >= level - slack)).select(*SPAN[: axes.dims])


def overlapping(spans: DataFrame, box: Sequence[tuple[float, float]]) -> DataFrame:
    """Spans that meet a box (lo_d, hi_d against its sides)."""
    for d, (a, b) in enumerate(box):
        spans = spans.where((F.col(f"hi_{d}") >= a) & (F.col(f"lo_{d}") <= b))
    return spans


def contained(spans: DataFrame, box: Sequence[tuple[float, float]]) -> DataFrame:
    """Spans that lie in a box."""
    for d, (a, b) in enumerate(box):
        spans = spans.where((F.col(f"lo_{d}") >= a) & (F.col(f"hi_{d}") <= b))
    return spans


def boundary(spans: DataFrame, axes: Axes, without_last_end: bool = False) -> DataFrame:
    """First or last spans of any dimension; the last dimension's end can be left out."""
    tests = F.lit(False)
    for d in range(axes.dims):
        tests = tests | (F.col(SPAN[d]) == axes.degree[d])
        if not (without_last_end and d == axes.dims - 1):
            tests = tests | (F.col(SPAN[d]) == axes.controls[d] - 1)
    return spans.where(tests)


def sign_change(values: DataFrame, order: str, size: int, value: str = "c") -> DataFrame:
    """Rows at which a window of `size` values of a sequence holds both signs (or zero)."""
    line = W.orderBy(order).rowsBetween(0, size - 1)  # a sequence is one axis
    return values.withColumns({"lo": F.min(value).over(line), "hi": F.max(value).over(line)}).where("lo <= 0 AND hi >= 0").drop("lo", "hi")
