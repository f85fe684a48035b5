"""A text index that grows with the case table: each appended part is read once, counted, and merged.

A part's folder holds what merges: its texts with their number of cases and term counts, marked where no
earlier part had them, the document frequencies it adds, and its leading cases. A row of ``versions`` is written
last, so a part that was cut short is not seen, and a version is appended once. Weights of all texts depend on
the number of cases and are derived again, from the counts that are stored; an appended part alone is cut into terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.functions.text import ENGLISH_STOP_WORDS
from caselink.operators.tfidf import distinct_texts, term_lists, unlisted, weight_lists, weighted
from caselink.sources.scratch import write_table
from caselink.sources.text_index import DEPTH, TextIndex, leading_cases


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions appended so far, in order; one row each."""
    try:
        rows = spark.read.schema("place int, version string").parquet(f"{path}/versions").collect()
    except AnalysisException:
        return []
    return [r["version"] for r in sorted(rows, key=lambda r: r["place"])]


def _tables(spark: SparkSession, path: str, known: Sequence[str], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/parts/{v}/{name}") for v in known])


def append(
    cases: DataFrame, path: str, version: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, depth: int = DEPTH
) -> None:
    """Add the cases of a new part. Only they are read; a version that is there already changes nothing."""
    spark = cases.sparkSession
    known = versions(spark, path)
    if version in known:
        return
    folder = f"{path}/parts/{version}"
    texts = write_table(distinct_texts(cases), f"{folder}/texts")
    fresh = F.lit(1)
    if known:
        earlier = _tables(spark, path, known, "texts").select("text_id").distinct()
        texts = texts.join(earlier.withColumn("_known", F.lit(1)), "text_id", "left")
        fresh = F.coalesce(1 - F.col("_known"), F.lit(1))
    # Texts met before are listed once more, with the number of their new cases, for the frequencies below.
    listed = term_lists(texts.select("text_id", "mo_text", "n_rows", fresh.alias("fresh")), stop_words)
    added = unlisted(write_table(listed, f"{folder}/term_lists"))
    terms = added.groupBy("term").agg(F.sum("n_rows").alias("df"), F.sum("fresh").alias("n_texts"))
    write_table(terms, f"{folder}/terms")
    write_table(leading_cases(cases, depth), f"{folder}/leaders")
    mark = spark.range(1).select(F.lit(len(known)).cast("int").alias("place"), F.lit(version).alias("version"))
    mark.write.mode("append").parquet(f"{path}/versions")


def load(spark: SparkSession, path: str, depth: int = DEPTH) -> TextIndex | None:
    """The index of all parts, equal to one that is fitted on all cases at once; None if nothing was appended."""
    known = versions(spark, path)
    if not known:
        return None
    read = lambda name: _tables(spark, path, known, name)
    texts = read("texts").groupBy("text_id").agg(
        F.first("mo_text").alias("mo_text"), F.sum("n_rows").alias("n_rows"), F.min("first_dr").alias("first_dr")
    )
    folder = f"{path}/merged/{len(known)}"
    texts = write_table(texts, f"{folder}/texts")
    corpus = texts.agg(F.sum("n_rows")).scalar()
    merged = read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_texts").alias("n_texts"))
    idf = write_table(merged.withColumn("idf", F.log((1 + corpus) / (1 + F.col("df"))) + 1), f"{folder}/idf")
    counted = read("term_lists").filter("fresh = 1").select("text_id", "terms")
    lists = counted.join(texts.select("text_id", "n_rows", "first_dr"), "text_id")
    lists = weighted(write_table(weight_lists(lists, idf), f"{folder}/idf_lists"))
    leaders = leading_cases(read("leaders"), depth)
    return TextIndex(texts, idf, unlisted(lists), write_table(leaders, f"{folder}/leaders"), depth, lists=lists)
