"""The fitted text index: tables that similar-case queries read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.functions.text import ENGLISH_STOP_WORDS, text_id
from caselink.operators.skew import heavy_keys, top_per_key
from caselink.operators.tfidf import (
    distinct_texts,
    inverse_document_frequency,
    term_counts,
    term_lists,
    text_lengths,
    text_sizes,
    texts_in_place,
    unlisted,
    weight_lists,
    weighted,
)
from caselink.schema import CASE_COLUMNS
from caselink.sources.scratch import shared_folder, write_table

# Default number of leading cases kept per text: the smallest candidate pool.
DEPTH = 200

# Texts of more than one case up to which their ids are sent to the cases; the others then stay where they are.
SHARED = 500_000

ABOUT = "depth int, fewest long, most long"


@dataclass(frozen=True)
class TextIndex:
    """
    texts    text_id, mo_text, n_rows, first_dr
    idf      term, df, n_texts, idf
    weights  text_id, n_rows, first_dr, term, tf, n_texts, weight
    leaders  text_id, leader_rank, and the case columns: the ``depth`` lowest ids of each text.
             Cases with one text are equally similar to anything and tie on the id, so no pool of
             ``depth`` rows can hold any other case.
             Of an index of part of the cases (``within``) they are the part's, as are ``n_rows`` and
             ``first_dr`` of ``texts``; terms and weights are those of all cases.
    cases    the table the index was made of; a pool deeper than ``depth`` takes its leaders from it.
    copies   fewest and most cases per text, known for a saved index; lets a query leave out the
             plan branch that no text needs.
    lists    the weights with one row per text: text_id, n_rows, first_dr, terms; None for part of the cases.
    counts, lengths
             of an index that keeps no weights (``load_or_fit_keyed``; ``weights`` and ``lists`` are None): the terms
             of each text as counted where the texts lie, and the length of its vector.
    """

    texts: DataFrame
    idf: DataFrame
    weights: DataFrame | None
    leaders: DataFrame | None
    depth: int
    copies: tuple[int, int] | None = None
    cases: DataFrame | None = None
    lists: DataFrame | None = None
    counts: DataFrame | None = None
    lengths: DataFrame | None = None


def leading_cases(cases: DataFrame, depth: int, sizes: DataFrame | None = None, shared: DataFrame | None = None, any_alone: bool = True) -> DataFrame:
    """Only the cases of texts that many share are cut in lanes first; the others are shuffled once.

    ``sizes`` has the number of cases of each text if that is known. With ``shared``, the texts of more than one case,
    a case whose text no other has is not shuffled: it is its text's only leader.
    """
    keyed = cases.select(text_id("mo_text").alias("text_id"), *CASE_COLUMNS)
    sizes = keyed.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_rows")) if sizes is None else sizes
    hot = F.broadcast(heavy_keys(sizes, "text_id", "n_rows").select("text_id"))
    several = keyed if shared is None else keyed.join(F.broadcast(shared.select("text_id")), "text_id", "left_semi")
    order = [F.asc("dr_no")]
    of_hot = top_per_key(several.join(hot, "text_id", "left_semi"), ["text_id"], order, depth, "leader_rank", lanes=256)
    others = top_per_key(several.join(hot, "text_id", "left_anti"), ["text_id"], order, depth, "leader_rank")
    leaders = others.unionByName(of_hot)
    if shared is None or not any_alone:
        return leaders
    alone = keyed.join(F.broadcast(shared.select("text_id")), "text_id", "left_anti")
    return leaders.unionByName(alone.withColumn("leader_rank", F.lit(1)))


def fit(
    cases: DataFrame,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    depth: int = DEPTH,
    path: str | None = None,
    with_leaders: bool = True,
) -> TextIndex:
    """Fit the index. With a ``path`` every table is written there and read back.

    ``with_leaders=False`` leaves out the leading cases when only the weights are wanted.
    """
    keep = (lambda df, name: df) if path is None else (lambda df, name: write_table(df, f"{path}/{name}"))
    # Texts are counted by their ids first, so that those of one case need not be shuffled.
    sizes = shared = None
    any_alone = True
    if path is not None:
        sizes = keep(text_sizes(cases), "sizes")
        n = sizes.agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("n_rows") > 1, 1)).alias("shared")).first()
        shared, any_alone = sizes.filter("n_rows > 1") if n["shared"] <= SHARED else None, n["texts"] > n["shared"]
    texts = keep(distinct_texts(cases) if shared is None else texts_in_place(cases, shared, any_alone), "texts")
    idf = keep(inverse_document_frequency(term_counts(texts, stop_words), texts), "idf")
    lists = weighted(keep(weight_lists(texts, idf, stop_words), "idf_lists"))
    leaders = keep(leading_cases(cases, depth, sizes, shared, any_alone), "leaders") if with_leaders else None
    return TextIndex(texts, idf, unlisted(lists), leaders, depth, cases=cases if with_leaders else None, lists=lists)


def leading_cases_by(cases: DataFrame, field: str, depth: int) -> DataFrame:
    """(text_id, part, n_rows, leader_rank, case columns): the ``depth`` lowest ids of each text under each value of ``field``."""
    keyed = cases.select(text_id("mo_text").alias("text_id"), F.col(field).alias("part"), *CASE_COLUMNS)
    sizes = keyed.groupBy("text_id", "part").agg(F.count(F.lit(1)).alias("n_rows"))
    leaders = top_per_key(keyed, ["text_id", "part"], [F.asc("dr_no")], depth, "leader_rank", lanes=256)
    same = leaders["text_id"].eqNullSafe(sizes["text_id"]) & leaders["part"].eqNullSafe(sizes["part"])
    return leaders.join(sizes, same).select(leaders["text_id"], leaders["part"], "n_rows", "leader_rank", *CASE_COLUMNS)


def within(index: TextIndex, field: str, value: str | None, path: str | None = None) -> TextIndex:
    """The index of the cases whose ``field`` is ``value`` (None: missing), with the weights of all cases.

    The leading cases of each text under each value are a table of their own, made once below ``path`` and then
    read for every value; one value's rows are a filter on it.
    """
    if index.cases is None:
        raise ValueError("the index does not know its cases")
    by = None
    if path is not None:
        try:
            by = index.cases.sparkSession.read.parquet(f"{path}/{field}")
        except AnalysisException:
            by = None
    if by is None:
        by = leading_cases_by(index.cases, field, index.depth)
        by = by if path is None else write_table(by, f"{path}/{field}")
    part = by.filter(F.col("part").eqNullSafe(F.lit(value)))
    firsts = part.filter("leader_rank = 1").select("text_id", "n_rows", F.col("dr_no").alias("first_dr"))
    texts = index.texts.select("text_id", "mo_text").join(firsts, "text_id")
    weights = index.weights.drop("n_rows").join(firsts.select("text_id", "n_rows"), "text_id")
    return replace(index, texts=texts, weights=weights, leaders=part.drop("part", "n_rows"), copies=None, lists=None, cases=index.cases.filter(F.col(field).eqNullSafe(F.lit(value))))


def table_fingerprint(cases: DataFrame, settings: str) -> str:
    """Name of exactly these cases under these settings; one pass over the table.

    Digests of rows are added up, so that repeated rows count as often as they occur. A hash passes over
    nulls, so each digest also takes in which columns are null.
    """
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in CASE_COLUMNS])
    row = cases.agg(
        F.count(F.lit(1)).alias("rows"),
        wide(nulls, *CASE_COLUMNS).alias("a"),
        wide(F.lit(settings), *reversed(CASE_COLUMNS), nulls).alias("b"),
    ).select(F.md5(F.concat_ws(":", "rows", "a", "b", F.lit(settings))).alias("name"))
    return row.first()["name"]


def fingerprint(cases: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, depth: int = DEPTH) -> str:
    """Name of the index of exactly these cases under these settings."""
    return table_fingerprint(cases, f"{depth}:{' '.join(stop_words)}")


def load(spark: SparkSession, path: str) -> TextIndex | None:
    """The index saved at ``path``, or None if there is no complete one."""
    try:
        about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
        lists = weighted(spark.read.parquet(f"{path}/idf_lists"))
    except AnalysisException:
        return None
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("texts", "idf", "leaders")]
    texts, idf, leaders = tables
    return TextIndex(texts, idf, unlisted(lists), leaders, about["depth"], (about["fewest"], about["most"]), lists=lists)


def _save_about(index: TextIndex, path: str) -> None:
    """Written last: its presence says that the other tables are whole."""
    index.texts.agg(
        F.lit(index.depth).alias("depth"),
        F.coalesce(F.min("n_rows"), F.lit(0)).alias("fewest"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("most"),
    ).write.mode("overwrite").parquet(f"{path}/about")


def load_or_fit(
    cases: DataFrame,
    path: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    depth: int = DEPTH,
    version: str | None = None,
) -> TextIndex:
    """Load the index of these cases from below ``path``; fit and save it if it is not there.

    The folder carries the fingerprint of the table, so an index of older data is never used. A caller
    who knows the table's ``version`` (a snapshot id, say) saves the pass that takes the fingerprint.
    """
    spark = cases.sparkSession
    folder = f"{path}/{version or fingerprint(cases, stop_words, depth)}"
    found = load(spark, folder)
    if found is None:
        _save_about(fit(cases, stop_words, depth, folder), folder)
        found = load(spark, folder)
    return replace(found, cases=cases)


def _counted(texts: DataFrame, spelled: DataFrame, stop_words: Sequence[str]) -> tuple[DataFrame, DataFrame | None, bool]:
    """``counts`` of a keyed index; the sizes of texts of more than one case, None above SHARED; whether any text has one case."""
    n = texts.agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("n_rows") > 1, 1)).alias("shared")).first()
    shared, any_alone = texts.filter("n_rows > 1").drop("mo_text"), n["texts"] > n["shared"]
    if n["shared"] <= SHARED:
        return term_lists(texts_in_place(spelled, shared, any_alone, "words"), stop_words), shared, any_alone
    one = spelled.groupBy(text_id("mo_text").alias("text_id")).agg(F.first("words").alias("mo_text"))
    return term_lists(one.join(texts.drop("mo_text"), "text_id"), stop_words), None, any_alone


def load_or_fit_keyed(
    cases: DataFrame,
    spelled: DataFrame,
    path: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    depth: int = DEPTH,
    version: str | None = None,
) -> TextIndex:
    """``load_or_fit`` of cases whose ``mo_text`` is the key of a text (``text_key``), for pools of few asked texts.

    ``spelled`` has the texts: one row (dr_no, mo_text, words) or more for each case's id and key, and no other
    keys. Texts are read where they lie, neither shuffled nor stored; of them only counts of terms are. Weights are not
    kept but made where they are needed, so asking for more texts than ``asked`` takes makes and stores them (``with_weights``).
    """
    spark = cases.sparkSession
    folder = f"{path}/{version or fingerprint(cases, stop_words, depth)}"
    try:
        about = spark.read.schema(ABOUT).parquet(f"{folder}/about").first()
        texts, idf, lengths, leaders = [spark.read.parquet(f"{folder}/{name}") for name in ("texts", "idf", "lengths", "leaders")]
        counts, _, _ = _counted(texts, spelled, stop_words)
    except AnalysisException:
        texts = write_table(distinct_texts(cases), f"{folder}/texts")
        counts, shared, any_alone = _counted(texts, spelled, stop_words)
        idf = write_table(inverse_document_frequency(unlisted(counts), texts), f"{folder}/idf")
        lengths = write_table(text_lengths(counts, idf), f"{folder}/lengths")
        leaders = write_table(leading_cases(cases, depth, texts, shared, any_alone), f"{folder}/leaders")
        _save_about(TextIndex(texts, idf, None, leaders, depth), folder)
        about = spark.read.schema(ABOUT).parquet(f"{folder}/about").first()
    copies = (about["fewest"], about["most"])
    return TextIndex(texts, idf, None, leaders, about["depth"], copies, cases, counts=counts, lengths=lengths)


def with_weights(index: TextIndex) -> TextIndex:
    """A keyed index with its weights, stored once for this application."""
    folder = shared_folder(index.idf.sparkSession, "weights", uuid.uuid4().hex)
    lists = weighted(write_table(weight_lists(index.counts, index.idf), f"{folder}/idf_lists"))
    return replace(index, weights=unlisted(lists), lists=lists, counts=None, lengths=None)
