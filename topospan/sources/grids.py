"""Point sets sampled from analytic signals, as DataFrames (i, j, ... , x, y, ..., value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..datasets import DATASETS
from ..functions.signals import number, signal

AXES = ("x", "y", "z", "t")
INDEX = ("i", "j", "k", "m")


def coordinates(n: Sequence[int], mins: Sequence[float], maxs: Sequence[float]) -> list[str]:
    """SQL text of each coordinate over index columns: min + i (max - min) / (n - 1)."""
    return [f"({number(a)} + {c} * {number((b - a) / max(k - 1, 1))})" for c, k, a, b in zip(INDEX, n, mins, maxs, strict=False)]


def lattice(spark: SparkSession, n: Sequence[int]) -> DataFrame:
    """All index tuples of a grid, the first index fastest; one stage, no shuffle."""
    total = 1
    for k in n:
        total *= k
    out = spark.range(total)
    step = 1
    for name, k in zip(INDEX, n, strict=False):
        out = out.withColumn(name, F.expr(f"(id div {step}L) % {k}L"))
        step *= k
    return out.drop("id")


def rectilinear(spark: SparkSession, name: str | Callable[..., Column], n: Sequence[int], mins: Sequence[float] | None = None, maxs: Sequence[float] | None = None, scale: float = 1.0, frequency: float = 1.0, noise: float = 0.0, twist: float = 0.0, rotate: float = 0.0, seed: int = 0, components: int = 1) -> DataFrame:
    """A regular grid of a signal: optional domain twist and rotation (radians), and multiplicative Gaussian noise.

    The signal is evaluated at the moved coordinates; several components give value, value_1, ...
    """
    d = DATASETS.get(name) if isinstance(name, str) else None
    mins, maxs = mins or d.mins[: len(n)], maxs or d.maxs[: len(n)]
    axes = AXES[: len(n)]
    out = lattice(spark, n).withColumns({a: F.expr(c) for a, c in zip(axes, coordinates(n, mins, maxs), strict=True)})
    if twist:
        out = twisted(out, twist)
    if rotate:
        out = rotated(out, rotate)
    for l in range(components):
        value = signal(name, axes, scale, frequency, l)
        out = out.withColumn("value" if l == 0 else f"value_{l}", value * (1 + noise * F.randn(seed + l)) if noise else value)
    return out


def twisted(df: DataFrame, t: float) -> DataFrame:
    """x + t sin y and y + t sin x, both of the old coordinates."""
    return df.withColumns({"x": F.col("x") + t * F.sin("y"), "y": F.col("y") + t * F.sin("x")})


def rotated(df: DataFrame, angle: float) -> DataFrame:
    c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    return df.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def random_cloud(spark: SparkSession, name: str | Callable[..., Column], n: int, mins: Sequence[float], maxs: Sequence[float], voids: Sequence[tuple[Sequence[float], float]] = (), seed: int = 0, scale: float = 1.0, frequency: float = 1.0) -> DataFrame:
    """About n points, uniform in the box outside spherical voids (centre, radius).

    Candidates are oversampled by the voids' share of the box, so that no iteration is needed; points
    are numbered by a hash, never ranked globally.
    """
    volume, gone = 1.0, 0.0
    for a, b in zip(mins, maxs, strict=True):
        volume *= b - a
    ball = {1: 2.0, 2: 3.141592653589793, 3: 4.18879020478639}
    for _, r in voids:
        gone += ball.get(len(mins), 4.93) * r ** len(mins)
    axes = AXES[: len(mins)]
    out = spark.range(int(n / max(0.05, 1 - gone / volume)) + 1).withColumns({c: a + F.rand(seed * 31 + k) * (b - a) for k, (c, a, b) in enumerate(zip(axes, mins, maxs, strict=True))})
    for centre, r in voids:
        out = out.where(sum((F.col(c) - m) * (F.col(c) - m) for c, m in zip(axes, centre, strict=True)) >= r * r)
    return out.withColumn("value", signal(name, axes, scale, frequency))


def analytic(spark: SparkSession, name: str, n: Sequence[int], structured: bool = True, random: bool = False, **options) -> DataFrame:
    """A grid, or a random cloud; a random cloud has no structure."""
    if structured and random:
        raise ValueError("a random point cloud can't be structured")
    if random:
        d = DATASETS[name]
        total = 1
        for k in n:
            total *= k
        return random_cloud(spark, name, total, options.pop("mins", d.mins), options.pop("maxs", d.maxs), **options)
    return rectilinear(spark, name, n, **options)


def pairs_1d(spark: SparkSession, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """A one-dimensional field from values in memory."""
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(xs, ys, strict=True))], "i long, x double, value double")


def bounds(df: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Bounds of a point set, for its model's domain."""
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in axes for n, f in (("min", F.min), ("max", F.max))))
