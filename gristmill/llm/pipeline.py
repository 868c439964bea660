"""The corpus pipeline: stages from raw documents to packed sequences, each by one of the operators.

Defined results: each stage takes nulls, ties, repeated rows, very long texts and extra columns as its operator says; a
null text fails the quality rules; an empty table passes through all stages as one; columns beside those of documents pass
all stages but the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import keep_first_copies
from .jaccard import keep_one_of_each
from .mixing import mixed_rows
from .packing import pack_sequences
from .quality import keep_good
from .queries import documents, tokenizer_file
from .shared import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity lies within their language's band."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that are equal but for white space."""
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar word shingles."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed corpus in sequences of 2048."""
    return pack_sequences(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, vocabulary=49_408)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard", near), ("mixing", mixing), ("packing", packing)]

#: SQL can express the quality stage, the copies and the mix, but not the tokenizers of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage kept on the shared folder goes once it is written."""
    return through(spark, documents(spark, sf_dir), sf_dir)


def through(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over given documents."""
    work = Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before = len(Workspace.open)
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        for used in Workspace.open[before:]:
            used.drop()
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
