"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and gives what
it reads back to the next stage. All but the last return the columns of ``docs``. Whole rows go through Python
workers, so the stages bound the bytes of an Arrow batch in the session, where it has no lower bound.

1. language_id: rows whose language cannot be told (no letter, or no clear winner) go.
2. near_dup: of each group of near-duplicate documents the one of the smallest id stays.
3. decontamination: documents that contain an item of ``benchmark`` go.
4. secret_scan: secrets are replaced by ``[SECRET]``; ``n_chars`` follows the new text.
5. sentencepiece: each whole text's token ids (``token_ids``) and their number (``n_tokens``) are added.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.llm import decontaminate, language_id, near_dup, secret_scan, sentencepiece_codec
from caselink.llm.common import bounded_batches, run_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return language_id.keep_identified(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dup.keep_one(docs, run_folder(spark, "stage_near_dup"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, items, run_folder(spark, "stage_decontamination"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    encoded = sentencepiece_codec.with_token_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A network's verdicts and a merge encoding are no SQL; tests hold ``run`` against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
