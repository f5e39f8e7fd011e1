"""The queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, licenses, line_dedup, media, mixing, near_dedup, pane_revisions, piece_codec, prefix_trie, quality, token_counts, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


# The documents have no paths: they stand as files in a directory for each source and language, every seventh id as a licence file.
LICENSE_PATH = """concat(coalesce(nullif(source, ''), '-'), '/', coalesce(nullif(lang, ''), '-'), '/', CASE WHEN doc_id % 7 = 0 THEN 'LICENSE-' ELSE '' END, coalesce(CAST(doc_id AS VARCHAR(20)), '-'), '.txt')"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir), F.expr(LICENSE_PATH))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_scores(_documents(spark, sf_dir))


def op13_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pane_revisions.click_panes(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_near_dedup": op2_near_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op4_media_columns": op4_media_columns,
        "op5_quality": op5_quality,
        "op6_licenses": op6_licenses,
        "op7_piece_codec": op7_piece_codec,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_line_dedup": op10_line_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_language_id": op12_language_id,
        "op13_pane_revisions": op13_pane_revisions,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.scan_sql(LICENSE_PATH), "op10_line_dedup": line_dedup.line_dedup_sql(), "op11_prefix_trie": prefix_trie.conversation_trie_sql(), "op13_pane_revisions": pane_revisions.click_panes_sql()}
