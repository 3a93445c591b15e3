"""The training-data pipeline: language ID, near duplicates, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topospan.llm import bestfit_pack, lsh_forest, rank_langid, secret_markov
from topospan.llm.common import fold, written

#: A text whose nearest profile is farther than this (1 - distance / largest distance) is in no known language.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts far from every language's profile."""
    known = rank_langid.train(docs.where(fold("doc_id", 3) != 1))
    kept = rank_langid.predict(docs, known).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts with a shingle similarity of 0.8 or more."""
    return lsh_forest.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [SECRET]; no document goes."""
    return secret_markov.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2048 words, without two documents of a source or two copies in one."""
    return bestfit_pack.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: No SQL can express the first stage's ranks and the second's groups over whole tables in bounded time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
