"""The operators' registered queries: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: A SentencePiece model of the installed public vocabularies; another is named by this variable.
MODEL = os.environ.get("TOPOSPAN_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ogg_media(spark, sf_dir):
    from .ogg_media import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op2_template_html(spark, sf_dir):
    from .template_html import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_interpolated_lm(spark, sf_dir):
    from .interp_lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_lsh_forest_join(spark, sf_dir):
    from .lsh_forest import similar

    return similar(table(spark, sf_dir, "documents"))


def op5_secret_markov(spark, sf_dir):
    from .secret_markov import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_block_matrix_ann(spark, sf_dir):
    from .blockmatrix_ann import self_search

    return self_search(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark, sf_dir):
    from .sp_backend import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), MODEL)


def op8_rank_langid(spark, sf_dir):
    from .rank_langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_pii_infotheory(spark, sf_dir):
    from .pii_infotheory import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_bestfit_packing(spark, sf_dir):
    from .bestfit_pack import pack_near

    return pack_near(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
