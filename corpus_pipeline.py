"""Corpus pipeline: from raw documents to encoded training text.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame.  Each stage works
on all rows that the one before kept; all but the last return the columns of ``documents``.

Nulls, empty and very long texts, repeated rows and clashing names are handled as each stage's module says: null texts
count as empty, without labels every document scores 0.5 and stays, copies of a document stay until near dedup takes one
of them.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import line_dedup, mixing, near_dedup, piece_codec, quality
from corpusmill.plans.scratch import materialize


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that recur go, from all documents but the first; documents that lose all lines go."""
    return line_dedup.deduped_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return piece_codec.piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

# The first stage is a fitted classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
