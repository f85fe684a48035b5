"""Registered queries of this package: opN_<name> over the whole table it is meant for, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caselink.llm import chat, decontaminate, importance, language_id, mixing, near_dup, repair, secret_scan, sentencepiece_codec, token_counts, token_files, vector_search, warc

Query = Callable[[SparkSession, str], DataFrame]
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.neighbours(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    probe = chat.probe_turns(spark)
    return chat.formatted_digests(turns.select(*probe.columns).unionByName(probe))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_digests(table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_near_dup,
        op3_secret_scan,
        op4_warc,
        op5_token_files,
        op6_sentencepiece,
        op7_decontamination,
        op8_language_id,
        op9_vector_search,
        op10_chat_format,
        op11_importance,
        op12_repair,
        op13_mixing,
    )
}
SQL: dict[str, str] = {"op2_near_dup": near_dup.SQL, "op4_warc": warc.SQL, "op7_decontamination": decontaminate.SQL, "op10_chat_format": chat.SQL, "op11_importance": importance.SQL, "op12_repair": repair.SQL, "op13_mixing": mixing.SQL}
