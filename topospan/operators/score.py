"""Scores and summaries of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def statistical_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = W.partitionBy(key).orderBy(F.desc("n"), value)
    return counts.withColumn("k", F.row_number().over(best)).where("k = 1").select(key, F.col(value).alias("mode"))


def persistence_counts(pairs: DataFrame, levels: int, most: float) -> DataFrame:
    """(level, n): pairs more persistent than each of evenly spaced levels, by one histogram.

    A pair counts for every level below it, so counts by the last such level are summed from above.
    """
    step = most / (levels - 1)
    spark = pairs.sparkSession
    level = spark.range(levels).select(F.col("id").alias("k"), (F.col("id") * most / (levels - 1)).alias("level"))
    pairs = pairs.where("persistence > 0")  # others count for no level
    low = F.least(F.floor(F.col("persistence") / step), F.lit(levels - 1)).cast("long")
    at = F.when(F.col("persistence") > low * most / (levels - 1), low).otherwise(low - 1)
    counts = pairs.groupBy(at.alias("k")).agg(F.count("*").alias("c"))
    above = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)  # as many rows as levels
    return level.join(F.broadcast(counts), "k", "left").withColumn("n", F.sum(F.coalesce("c", F.lit(0))).over(above)).select("level", "n")


def root_check(points: DataFrame, columns: list[str], eps: float) -> DataFrame:
    """One row: points, those whose residual (the norm of the columns) exceeds eps, and the largest residual."""
    norm = F.sqrt(sum(F.col(c) * F.col(c) for c in columns))
    return points.agg(F.count("*").alias("n"), F.count(F.when(norm > eps, 1)).alias("not_roots"), F.max(norm).alias("largest"))


def function_error(points: DataFrame, value: str = "value", truth: str = "truth") -> DataFrame:
    """One row: least, largest and mean |value - truth|."""
    e = F.abs(F.col(value) - F.col(truth))
    return points.agg(F.min(e).alias("least"), F.max(e).alias("largest"), F.avg(e).alias("mean"))


def average_norm(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.avg(F.sqrt(sum(F.col(c) * F.col(c) for c in columns))).alias("average_norm"))
