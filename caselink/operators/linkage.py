"""Pairs of base and candidate: features, labels, samples, training pairs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.functions.pairs import is_relevant, pair_features
from caselink.functions.text import text_or_empty
from caselink.operators.similarity import similar_cases
from caselink.operators.skew import first_rows
from caselink.sources.scratch import shared_folder, write_table
from caselink.sources.text_index import TextIndex

Relevance = Callable[[Column, Column], Column]

SAMPLE_SEED = 42
TRAINING_K = 15


def with_features(ranked: DataFrame) -> DataFrame:
    """Add the pair features to (base, similarity, cand) rows."""
    columns = pair_features(F.col("similarity"), F.col("base"), F.col("cand"))
    return ranked.withColumns(columns)


def with_label(ranked: DataFrame, relevance: Relevance = is_relevant) -> DataFrame:
    """Add ``label``: 1 if the candidate is relevant to the base."""
    return ranked.withColumn("label", relevance(F.col("base"), F.col("cand")).cast("int"))


#: Of 100 groups of cases with one text, how many are for training; the others are held out.
TRAINING_SHARE = 80


def held_out(text: Column | str = "mo_text", seed: int = SAMPLE_SEED) -> Column:
    """Whether a case of this text is held out from training.

    A digest of text and seed decides, so all cases of one text are on one side, and a new case does not
    change the side of another.
    """
    digest = F.md5(F.concat(text_or_empty(text), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 >= TRAINING_SHARE


def sample_cases(
    cases: DataFrame,
    n: int,
    seed: int = SAMPLE_SEED,
    required: Sequence[str] = ("crm_cd", "area_name", "mo_text"),
) -> DataFrame:
    """``n`` cases that have all required values, or all such cases if there are fewer.

    The order of the ids' digests draws the sample, so it depends on seed and ids alone and not on
    how the table is split.
    """
    digest = F.md5(F.concat(F.col("dr_no").cast("string"), F.lit(f":{seed}")))
    usable = cases.dropna(subset=list(required))
    # Only ids are drawn; the wide rows of the few that win are taken afterwards.
    drawn = first_rows(usable.select("dr_no", digest.alias("_digest")), [F.asc("_digest"), F.asc("dr_no")], n)
    return usable.join(drawn.select("dr_no"), "dr_no", "left_semi")


def stored_sample(cases: DataFrame, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """``sample_cases``, written once to the shared folder for plans that use it in several places."""
    return write_table(sample_cases(cases, n, seed), shared_folder(cases.sparkSession, "samples", uuid.uuid4().hex))


def training_pairs(
    index: TextIndex,
    cases: DataFrame,
    n: int = 500,
    seed: int = SAMPLE_SEED,
    k: int = TRAINING_K,
    relevance: Relevance = is_relevant,
    apart: bool = False,
) -> DataFrame:
    """Sampled bases with their most similar cases, features and label; one job for all bases.

    With ``apart``, neither a base nor a case it is paired with is held out.
    """
    bases = stored_sample(cases.filter(~held_out()) if apart else cases, n, seed)
    if apart:
        # A pool wide enough that about ``k`` stay when those held out go.
        near = similar_cases(index, bases, 2 * k).filter(~held_out(F.col("cand.mo_text")))
        by_base = W.partitionBy("base.dr_no").orderBy("rank")
        near = near.withColumn("rank", F.row_number().over(by_base)).filter(F.col("rank") <= k)
        return with_label(with_features(near), relevance)
    return with_label(with_features(similar_cases(index, bases, k)), relevance)


def label_rate(pairs: DataFrame) -> DataFrame:
    """One row: pairs, relevant pairs, share of relevant pairs."""
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("positives"),
        F.avg("label").alias("positive_rate"),
    )
