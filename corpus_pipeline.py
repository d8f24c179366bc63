"""Corpus pipeline: from documents to packed sequences, each stage written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from markertree.llm import packing, quality, simhash, substring, toxicity
from markertree.llm.common import table
from markertree.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. The model learns from the labelled rows of the whole table, as op8 does."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the quality classifier of op4."""
    sample = quality.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")
    return quality.kept_rows(docs, quality.fit(sample))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash component (op9: four-word shingles, at most four bits)."""
    return simhash.representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that nearly repeat one of an earlier document are cut out of their texts."""
    return substring.without_passages(docs, substring.duplicate_passages(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 2048 tokens."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None
"""The learned and the packed stages have no SQL; tests/llm tests their operators, not yet run() as a whole."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
