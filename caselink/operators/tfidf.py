"""TF-IDF over a text column, held as tables.

Similarity depends on the text alone, so everything is kept per distinct text and weighted by how
many cases share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.functions.text import ENGLISH_STOP_WORDS, is_term, text_id, text_or_empty, tokens
from caselink.operators.skew import heavy_keys, spread_join

# So many of the most frequent terms at most are broadcast with their frequencies.
COMMON = 500_000


def distinct_texts(cases: DataFrame) -> DataFrame:
    """(text_id, mo_text, n_rows, first_dr): one row per distinct text, null counting as empty."""
    return (
        cases.select("dr_no", text_or_empty("mo_text").alias("mo_text"))
        .groupBy("mo_text")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("dr_no").alias("first_dr"))
        .select(text_id("mo_text").alias("text_id"), "mo_text", "n_rows", "first_dr")
    )


def text_sizes(cases: DataFrame) -> DataFrame:
    """(text_id, n_rows, first_dr): ``distinct_texts`` without the texts, which are not shuffled for it."""
    return (
        cases.select(text_id("mo_text").alias("text_id"), "dr_no")
        .groupBy("text_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("dr_no").alias("first_dr"))
    )


def texts_in_place(cases: DataFrame, shared: DataFrame, any_alone: bool = True, words: str = "mo_text") -> DataFrame:
    """``distinct_texts`` where ``shared`` has the sizes of all texts of more than one case, few enough to be sent.

    A text of one case stays where it is; of the others, the copies with the lowest id are shuffled.
    ``words`` names the column with the text itself where ``mo_text`` is a key of it (``text_key``).
    """
    keyed = cases.select(text_id("mo_text").alias("text_id"), text_or_empty(words).alias("mo_text"), "dr_no")
    sent = F.broadcast(shared)
    several = (
        keyed.join(sent, "text_id")
        .filter(F.col("dr_no").eqNullSafe(F.col("first_dr")))
        .groupBy("text_id", "n_rows", "first_dr")
        .agg(F.first("mo_text").alias("mo_text"))
        .select("text_id", "mo_text", "n_rows", "first_dr")
    )
    if not any_alone:
        return several
    alone = keyed.join(sent, "text_id", "left_anti")
    return alone.select("text_id", "mo_text", F.lit(1).cast("long").alias("n_rows"), F.col("dr_no").alias("first_dr")).unionByName(several)


def tokenize(texts: DataFrame, keep: Sequence[str], stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """One row per token of ``mo_text`` that is no stop word."""
    return texts.select(*keep, F.explode(tokens("mo_text")).alias("term")).filter(
        is_term(F.col("term"), stop_words)
    )


def term_lists(texts: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """``texts`` with ``terms``, an array of (term, tf), in place of ``mo_text``; counted inside each row, no shuffle."""
    words = F.filter(tokens("mo_text"), lambda w: is_term(w, stop_words))
    sorted_words = texts.withColumn("_words", F.sort_array(words)).drop("mo_text")
    begins = F.filter(
        F.sequence(F.lit(0), F.size("_words") - 1),
        lambda i: (i >= 0) & ((i == 0) | (F.get("_words", i) != F.get("_words", i - 1))),
    )
    entry = lambda at, i: F.struct(
        F.get("_words", at).alias("term"), (F.coalesce(F.get("_begins", i + 1), F.size("_words")) - at).cast("long").alias("tf")
    )
    terms = F.when(F.size("_words") > 0, F.transform("_begins", entry)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
    return sorted_words.withColumn("_begins", begins).withColumn("terms", terms).drop("_words", "_begins")


def unlisted(lists: DataFrame) -> DataFrame:
    """One row for each entry of ``terms``, its fields as columns."""
    # The outer form: Spark would count all terms twice to leave out rows without any beforehand.
    rest = [c for c in lists.columns if c != "terms"]
    return lists.select(*rest, F.inline_outer("terms")).filter(F.col("term").isNotNull())


def term_counts(texts: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(text_id, n_rows, first_dr, term, tf)."""
    return unlisted(term_lists(texts, stop_words))


def inverse_document_frequency(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, df, n_texts, idf): ``df`` counts cases, ``n_texts`` distinct texts."""
    corpus = texts.agg(F.sum("n_rows")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.sum("n_rows").alias("df"), F.count(F.lit(1)).alias("n_texts"))
        .withColumn("idf", F.log((1 + corpus) / (1 + F.col("df"))) + 1)
    )


def _least_common(idf: DataFrame) -> int:
    """The least ``n_texts`` with which a term is broadcast: as low as leaves COMMON terms at most."""
    sizes = idf.groupBy("n_texts").agg(F.count(F.lit(1)).alias("terms"))
    so_far = F.sum("terms").over(W.orderBy(F.desc("n_texts")))
    least = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= COMMON).agg(F.min("n_texts").alias("n")).first()["n"]
    return (1 << 62) if least is None else least


def weight_lists(texts: DataFrame, idf: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(text_id, n_rows, first_dr, terms, length), ``terms`` being (term, tf, n_texts, idf); ``weighted`` makes weights of it.

    ``texts`` have ``mo_text``, or the ``terms`` that were counted before. The most frequent terms, at most COMMON,
    are broadcast; only the counts of the others meet ``idf`` in a shuffle and go back to their text. So most counts
    never leave the task that has their text. A weight differs in every row, while few values of ``idf`` do, so the
    latter is what is kept.
    """
    listed = (lambda df: df) if "terms" in texts.columns else (lambda df: term_lists(df, stop_words))
    least = _least_common(idf)
    common = F.broadcast(idf.filter(F.col("n_texts") >= least).select("term", F.col("n_texts").alias("_n"), F.col("idf").alias("_idf")))
    rare = (
        unlisted(listed(texts).select("text_id", "terms"))
        .join(common, "term", "left_anti")
        .join(idf.filter(F.col("n_texts") < least).select("term", "n_texts", "idf"), "term")
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("term", "tf", "n_texts", "idf")).alias("_rare"))
    )
    empty = F.array().cast("array<struct<term:string,tf:bigint,n_texts:bigint,idf:double>>")
    unknown = [F.lit(None).cast("bigint").alias("n_texts"), F.lit(None).cast("double").alias("idf")]
    counted = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), *unknown))
    both = listed(texts.join(rare, "text_id", "left")).select(
        "text_id", "n_rows", "first_dr", F.concat(counted, F.coalesce("_rare", empty)).alias("terms")
    )
    # Each rare term stands twice: as counted, which finds nothing here and goes, and as found above.
    found = unlisted(both).join(common, "term", "left").withColumn("_idf", F.coalesce("_idf", "idf")).filter(F.col("_idf").isNotNull())
    entry = F.struct("term", "tf", F.coalesce("_n", "n_texts").alias("n_texts"), F.col("_idf").alias("idf"))
    lists = found.groupBy("text_id", "n_rows", "first_dr").agg(F.collect_list(entry).alias("terms"))
    total = lambda square, t: square + (t["tf"] * t["idf"]) * (t["tf"] * t["idf"])
    return lists.withColumn("length", F.aggregate("terms", F.lit(0.0), total, F.sqrt))


def text_lengths(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(text_id, length) as in ``weight_lists``, of texts with at least one term; ``counts`` has the ``terms`` of ``term_lists``.

    A length is a sum over terms, so neither the text nor its list has to move: only the counts of rare terms and
    sums of squares are shuffled.
    """
    least = _least_common(idf)
    single = unlisted(counts.select("text_id", "terms"))
    common = F.broadcast(idf.filter(F.col("n_texts") >= least).select("term", "idf"))
    rare = idf.filter(F.col("n_texts") < least).select("term", "idf")
    found = single.join(common, "term")
    if not rare.isEmpty():
        found = found.unionByName(single.join(common, "term", "left_anti").join(rare, "term"))
    weight = F.col("tf") * F.col("idf")
    return found.groupBy("text_id").agg(F.sqrt(F.sum(weight * weight)).alias("length"))


def weighted(lists: DataFrame) -> DataFrame:
    """(text_id, n_rows, first_dr, terms) of ``weight_lists``, ``terms`` being (term, tf, n_texts, weight): tf * idf, scaled to length 1 per text."""
    scaled = lambda t: F.struct(
        t["term"].alias("term"), t["tf"].alias("tf"), t["n_texts"].alias("n_texts"), (t["tf"] * t["idf"] / F.col("length")).alias("weight")
    )
    return lists.select("text_id", "n_rows", "first_dr", F.transform("terms", scaled).alias("terms"))


def corpus_stats(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: cases, distinct terms, stored (case, term) weights."""
    per_term = counts.groupBy("term").agg(F.sum("n_rows").alias("stored"))
    return per_term.agg(
        F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored_elements")
    ).select(texts.agg(F.sum("n_rows")).scalar().alias("n_rows"), "vocabulary", "stored_elements")


def per_case(cases: DataFrame, texts: DataFrame, rows: DataFrame, cases_are_all: bool = False) -> DataFrame:
    """Rows held per ``text_id`` -> rows per case (``dr_no``), for all cases that share the text.

    ``cases_are_all`` says that ``texts`` were made of exactly these cases. Rows of a text that one case has then
    take its id from ``first_dr`` and are not shuffled; ``rows`` must have ``n_rows`` and ``first_dr``.
    """
    ids = cases.select("dr_no", text_id("mo_text").alias("text_id"))
    if not cases_are_all:
        heavy = heavy_keys(texts, "text_id", "n_rows")
        return spread_join(ids, rows, "text_id", heavy, "dr_no").drop("text_id")
    # Ids alone are counted: grouping the texts again would shuffle them.
    heavy = heavy_keys(ids.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_rows")), "text_id", "n_rows")
    shared = spread_join(ids, rows.filter("n_rows > 1"), "text_id", heavy, "dr_no").drop("text_id")
    single = rows.filter("n_rows = 1").withColumn("dr_no", F.col("first_dr")).drop("text_id")
    return shared.unionByName(single)
