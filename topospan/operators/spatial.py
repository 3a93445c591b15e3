"""Distance joins by cells: equality on a bucketed cell, then the exact distance.

`abs(a - b) < eps` alone would be planned as a nested loop; here each point of one side stands in
its cell and each of the other in its own and the neighbouring cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components


def _cell(columns: Sequence[str], size: float) -> Column:
    return F.array(*(F.floor(F.col(c) / size).cast("long") for c in columns))


def _around(dims: int) -> Column:
    offsets = [[]]
    for _ in range(dims):
        offsets = [o + [k] for o in offsets for k in (-1, 0, 1)]
    return F.array(*(F.array(*(F.lit(k).cast("long") for k in o)) for o in offsets))


def pairs_within(a: DataFrame, b: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), id_col: str = "id") -> DataFrame:
    """(a, b, d2): ids of all pairs at a distance of at most eps."""
    left = a.select(F.col(id_col).alias("a"), *(F.col(c).alias(f"a_{c}") for c in axes), _cell(axes, eps).alias("cell"))
    near = F.transform(_around(len(axes)), lambda o: F.zip_with(_cell(axes, eps), o, lambda p, q: p + q))
    right = b.select(F.col(id_col).alias("b"), *(F.col(c).alias(f"b_{c}") for c in axes), F.explode(near).alias("cell"))
    d2 = sum((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in axes)
    return left.join(right, "cell").withColumn("d2", d2).where(F.col("d2") <= eps * eps).select("a", "b", "d2")


def near_any(a: DataFrame, b: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), id_col: str = "id") -> DataFrame:
    """The rows of `a` with a row of `b` within eps."""
    hit = pairs_within(a, b, eps, axes, id_col).select(F.col("a").alias(id_col)).distinct()
    return a.join(hit, id_col, "left_semi")


def near_none(a: DataFrame, b: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), id_col: str = "id") -> DataFrame:
    hit = pairs_within(a, b, eps, axes, id_col).select(F.col("a").alias(id_col)).distinct()
    return a.join(hit, id_col, "left_anti")


def nearest(a: DataFrame, b: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), id_col: str = "id") -> DataFrame:
    """(a, b, d2): for each row of `a` the nearest of `b` within eps, ties to the least id."""
    best = W.partitionBy("a").orderBy("d2", "b")
    return pairs_within(a, b, eps, axes, id_col).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def eps_clusters(points: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), id_col: str = "id") -> DataFrame:
    """(id, leader): points joined by chains of steps of at most eps; the leader is the component's least id."""
    ties = pairs_within(points, points, eps, axes, id_col).where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = components(ties)
    return points.select(id_col).join(roots.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("root", id_col).alias("leader"))


def eps_distinct(points: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), id_col: str = "id") -> DataFrame:
    """One row of each eps-component: the one with the least coordinates, whatever the rows' order."""
    clusters = eps_clusters(points, eps, axes, id_col)
    best = W.partitionBy("leader").orderBy(*axes, id_col)
    return points.join(clusters, id_col).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "leader")


def overlap(a: DataFrame, b: DataFrame, eps: float, axes: Sequence[str] = ("x", "y"), type_col: str | None = "type", merge_types: dict[int, int] | None = None) -> DataFrame:
    """One row: matched and unmatched counts of both sets, and matched rows of `a` whose nearest row of `b` has its type.

    merge_types renames types of `b` before they are compared.
    """
    pairs = pairs_within(a, b, eps, axes)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(a, "n_a").crossJoin(n(b, "n_b")).crossJoin(pairs.agg(F.count_distinct("a").alias("matched_a"), F.count_distinct("b").alias("matched_b")))  # one row each
    if type_col:
        kind = F.col(type_col)
        for old, new in (merge_types or {}).items():
            kind = F.when(kind == old, new).otherwise(kind)
        best = W.partitionBy("a").orderBy("d2", "b")
        one = pairs.withColumn("n", F.row_number().over(best)).where("n = 1").join(a.select(F.col("id").alias("a"), F.col(type_col).alias("ta")), "a").join(b.select(F.col("id").alias("b"), kind.alias("tb")), "b")
        out = out.crossJoin(one.agg(F.coalesce(F.sum(F.when(F.col("ta") == F.col("tb"), 1).otherwise(0)), F.lit(0)).alias("same_type")))
    return out.withColumns({"unmatched_a": F.col("n_a") - F.col("matched_a"), "unmatched_b": F.col("n_b") - F.col("matched_b")})


def assign_span(points: DataFrame, spans: Sequence[int], mins: Sequence[float], maxs: Sequence[float], degree: Sequence[int], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Adds the knot span of each point per axis (uniform knots: arithmetic, no join); points outside the domain raise."""
    out = points
    for c, n, a, b, p, name in zip(axes, spans, mins, maxs, degree, ("si", "sj", "sk", "sm"), strict=False):
        u = (F.col(c) - a) / (b - a)
        out = out.withColumn(name, F.when(u.between(0, 1), F.least(F.floor(u * n), F.lit(n - 1)) + p).otherwise(F.raise_error(F.lit("a point is outside the domain"))).cast("long"))
    return out


def neighbour_spans(traces: DataFrame) -> DataFrame:
    """(si, sj, ni, nj): for each span that holds traces, those of the 3 x 3 spans around it that do."""
    own = traces.select("si", "sj").distinct()
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    around = own.withColumn("o", F.explode(offsets)).select("si", "sj", (F.col("si") + F.col("o.a")).alias("ni"), (F.col("sj") + F.col("o.b")).alias("nj"))
    return around.join(own.select(F.col("si").alias("ni"), F.col("sj").alias("nj")), ["ni", "nj"], "left_semi")
