"""Graphs as (vid, ...) and (src, dst) DataFrames: components, Betti numbers, sub-graphs, merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written


SMALL_EDGES = 200_000


def _merged_labels(own: pd.DataFrame) -> pd.DataFrame:
    """Components of a small graph, by repeated least labels with pointer jumping."""
    nodes, at = np.unique(np.concatenate((own["src"], own["dst"])), return_inverse=True)
    a, b = at[: len(own)], at[len(own) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return pd.DataFrame({"node": nodes, "root": nodes[label]})
        label = new


def components(edges: DataFrame, most_rounds: int = 60, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    A graph counted to have at most `small_edges` distinct edges is solved in one task. Beyond: large-star and small-star rounds (Kiveris et al., 2014): each is sums and joins by node, so a
    node of very many edges is only a skewed join key, and long chains settle in logarithmic time.
    """
    edges = written(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "edges").df
    if edges.count() <= small_edges:
        return edges.groupBy().applyInPandas(_merged_labels, "node long, root long")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    e = written(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a != b").distinct(), "cc")
    state = None
    for _ in range(most_rounds):
        both = e.df.union(e.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "cc")
        met = large.df.join(large.df.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = written(met.select("a", F.col("m").alias("b")).union(met.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a != b").distinct(), "cc")
        e.drop()
        large.drop()
        e, last = small, state
        state = e.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return nodes.join(e.df.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    raise RuntimeError("components didn't settle")


def betti(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, isolated, components (isolated ones apart), loops, deg3 (nodes of 3 edges or more).

    loops = edges - vertices + components + isolated.
    """
    roots = components(edges)
    degree = edges.select(F.col("src").alias("vid")).union(edges.select("dst")).groupBy("vid").agg(F.count("*").alias("degree"))
    v = vertices.select("vid").distinct().join(degree, "vid", "left").agg(F.count("*").alias("vertices"), F.sum(F.when(F.col("degree").isNull(), 1).otherwise(0)).alias("isolated"), F.sum(F.when(F.col("degree") >= 3, 1).otherwise(0)).alias("deg3"))
    e = edges.agg(F.count("*").alias("edges"))
    c = roots.where("node = root").agg(F.count("*").alias("components"))
    row = v.crossJoin(e).crossJoin(c)  # one row each
    return row.select("vertices", "edges", F.coalesce("isolated", F.lit(0)).alias("isolated"), "components", (F.col("edges") - F.col("vertices") + F.col("components") + F.coalesce("isolated", F.lit(0))).alias("loops"), F.coalesce("deg3", F.lit(0)).alias("deg3"))


def numbered(df: DataFrame, by: list[str], name: str = "vid") -> DataFrame:
    """Dense ids from 0 in the order of `by`, by range partitions: counts of partitions are summed, no row is ranked globally."""
    held = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()), "numbered").df
    first = held.groupBy("__p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("__p").orderBy(*by))
    return held.withColumn("__n", place).join(F.broadcast(first), "__p").withColumn(name, F.col("before") + F.col("__n") - 1).drop("__p", "__n", "before")


def induced(vertices: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The sub-graph of the vertices that `keep` holds for, re-numbered: (vertices, edges)."""
    kept = numbered(vertices.where(keep).withColumnRenamed("vid", "old"), ["old"])
    ids = kept.select("old", "vid")
    e = edges.join(ids.select(F.col("old").alias("src"), F.col("vid").alias("a")), "src").join(ids.select(F.col("old").alias("dst"), F.col("vid").alias("b")), "dst")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return kept.drop("old"), e.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)


def without_border_edges(vertices: DataFrame, edges: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Drops edges with both ends on the vertices' bounding box, and vertices that no edge uses; re-numbered."""
    box = vertices.agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    near = lambda c: (F.abs(F.col(c) - F.col(f"{c}_lo")) <= tolerance) | (F.abs(F.col(c) - F.col(f"{c}_hi")) <= tolerance)
    marked = vertices.crossJoin(F.broadcast(box)).select("vid", (near("x") | near("y")).alias("border"))  # a box of one row
    e = edges.join(marked.select(F.col("vid").alias("src"), F.col("border").alias("b1")), "src").join(marked.select(F.col("vid").alias("dst"), F.col("border").alias("b2")), "dst").where("NOT (b1 AND b2)").drop("b1", "b2")
    used = e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct()
    return induced(vertices.join(used, "vid", "left_semi"), e, F.lit(True))


def merged(vertices: DataFrame, edges: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Vertices equal after rounding to `tolerance` become one (the least); edges follow, loops and repeats go."""
    cell = F.struct(*(F.round(F.col(c) / tolerance).cast("long").alias(c) for c in ("x", "y")))
    to = vertices.select("vid", cell.alias("cell"))
    first = to.groupBy("cell").agg(F.min("vid").alias("new"))
    ids = to.join(first, "cell").select("vid", "new")
    e = edges.join(ids.select(F.col("vid").alias("src"), F.col("new").alias("a")), "src").join(ids.select(F.col("vid").alias("dst"), F.col("new").alias("b")), "dst").where("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return vertices.join(first.select(F.col("new").alias("vid")), "vid", "left_semi"), e


def typed_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the type of their first vertex."""
    return edges.join(vertices.select(F.col("vid").alias("src"), "type"), "src").select("src", "dst", "type")
