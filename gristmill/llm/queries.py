"""The thin queries opN_<name> over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import format_dialogues
from .exact_dedup import exact_dedup
from .jaccard import similar_components
from .licenses import document_path, scan_licenses
from .mixing import mix_sources
from .neural_lm import score_documents
from .packed_ids import read_packed_ids, write_packed_ids
from .packing import pack_sequences
from .oracles import oracle_sql as oracle_sql
from .quality import BASE, quality_report
from .repeats import remove_repeats


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir)).select("doc_id", *BASE, "kept")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), path=document_path())


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op6_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dialogues(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_packed_ids(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)
    return read_packed_ids(spark, shards)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1, vocabulary=49_408)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality, op3_licenses, op4_jaccard, op5_repeats, op6_chat_turns, op7_source_mix, op8_packed_ids, op9_pack_sequences, op10_lm_scores)}
