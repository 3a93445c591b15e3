"""Lines in Radon coordinates (t along the line, rho, alpha), and integrals along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signals import signal_sql


def to_cartesian(t: Column, rho: Column, alpha: Column) -> tuple[Column, Column]:
    """The point at t on the line whose normal has the angle alpha, at the distance rho from the origin."""
    return rho * F.cos(alpha) - t * F.sin(alpha), rho * F.sin(alpha) + t * F.cos(alpha)


def dual(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(rho, alpha) of the line through two points."""
    alpha = F.atan2(-(x1 - x0), y1 - y0)
    return x0 * F.cos(alpha) + y0 * F.sin(alpha), alpha


def box_span(rho: Column, alpha: Column, mins: Sequence[float], maxs: Sequence[float]) -> tuple[Column, Column]:
    """Where a line enters and leaves a box, as t; entering is past leaving where it misses."""
    lows, highs = [], []
    for at, way, a, b in ((rho * F.cos(alpha), -F.sin(alpha), mins[0], maxs[0]), (rho * F.sin(alpha), F.cos(alpha), mins[1], maxs[1])):
        flat = F.abs(way) < 1e-12
        inside = (at >= a) & (at <= b)
        t1, t2 = (a - at) / way, (b - at) / way
        lows.append(F.when(flat, F.when(inside, F.lit(-1e300)).otherwise(F.lit(1e300))).otherwise(F.least(t1, t2)))
        highs.append(F.when(flat, F.when(inside, F.lit(1e300)).otherwise(F.lit(-1e300))).otherwise(F.greatest(t1, t2)))
    return F.greatest(*lows), F.least(*highs)


def trapezoid(samples: DataFrame, keys: Sequence[str], order: str, value: str, step: float | Column) -> DataFrame:
    """The trapezoid rule along each key's samples."""
    line = W.partitionBy(*keys).orderBy(order)
    pairs = samples.withColumn("__next", F.lead(value).over(line))
    return pairs.groupBy(*keys).agg(F.sum((F.col(value) + F.col("__next")) / 2 * step).alias("value"))


def sinogram(lines: DataFrame, name: str, mins: Sequence[float], maxs: Sequence[float], steps: int = 200) -> DataFrame:
    """(line, value): the integral of a signal over the part of each line (line, rho, alpha) inside a box."""
    enter, leave = box_span(F.col("rho"), F.col("alpha"), mins, maxs)
    cut = lines.withColumns({"t0": enter, "t1": leave}).where("t1 > t0")
    s = cut.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("t", F.col("t0") + F.col("s") * (F.col("t1") - F.col("t0")) / steps)
    x, y = to_cartesian(F.col("t"), F.col("rho"), F.col("alpha"))
    v = s.withColumns({"x": x, "y": y}).withColumn("v", F.expr(signal_sql(name, ["x", "y"])))
    weight = F.when((F.col("s") == 0) | (F.col("s") == steps), 0.5).otherwise(1.0)
    return v.groupBy("line").agg(F.sum(F.col("v") * weight * (F.col("t1") - F.col("t0")) / steps).alias("value"))


def compression(n_input: int, n_controls: int, dims: int = 2, variables: int = 1) -> float:
    """Input values over model values."""
    return n_input * (dims + variables) / (n_controls * variables)
