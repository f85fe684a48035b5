"""Exact nearest texts of free text without summing every pair that shares a term.

Terms are ordered by how many texts have them, rarest first. The remainder of a text at a term is the length of its
vector from that term on. All terms that two texts share stand at or after the first one they share, so their cosine
is at most the product of their remainders there. With a floor under the similarity of the last text that counts:

1. Floors. Each asked text meets the heaviest postings of its rarest terms, enough for a few times ``depth`` texts.
   Of these the best by partial sums are summed in full; the ``depth``-th of them is a floor, as at least ``depth``
   texts are that near. A text that meets too few has floor 0, and all that share a term with it are candidates.
2. Candidates. A posting meets an asked text only if the product of remainders reaches the floor. The remainders are
   cut into slots that are part of the join key, so that postings which cannot reach it are not even met: frequent
   terms meet where most of either vector is made of them, and nowhere else. The terms met by a pair are the first
   ones it shares, so its sum so far plus the product of the remainders after the last of them is an upper bound;
   pairs below the floor go. The sums so far raise the floor once more.
3. Sums. What is left is summed in full.

Bounds are compared with a margin for rounding, so no text that ties with the last one is lost.

These steps shuffle pairs, which grow faster than the texts. Above ROWS rows of them the same texts are found in blocks
instead (``blocks``), which shuffle no pair.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.operators.blocks import nearest_in_blocks
from caselink.operators.skew import top_per_key
from caselink.sources.scratch import shared_folder, write_table

# Bounds within this of a floor count as reaching it; similarities are rounded to 9 places.
MARGIN = 1e-8
# Postings that an asked text meets for its floor, and texts summed in full for it, as multiples of ``depth``.
MET, SUMMED = 4, 2
# Rows of pairs that are shuffled at most.
ROWS = 1 << 22
# Slots halve the squared remainder twice; the last one holds all that is smaller.
SLOTS_PER_HALVING, LAST_SLOT = 2, 40


def _slot(square: Column) -> Column:
    """Slot of a squared remainder: 0 holds the largest."""
    fine = F.floor(-F.log2(F.greatest(square, F.lit(1e-30))) * SLOTS_PER_HALVING)
    return F.least(F.greatest(fine, F.lit(0)), F.lit(LAST_SLOT)).cast("int")


def with_remainders(weights: DataFrame) -> DataFrame:
    """(text_id, n_rows, term, n_texts, weight, rest, after): squared remainders with and without the term itself."""
    frequent_first = W.partitionBy("text_id").orderBy(F.desc("n_texts"), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
    square = F.col("weight") * F.col("weight")
    rest = F.sum(square).over(frequent_first)
    return weights.select("text_id", "n_rows", "term", "n_texts", "weight", rest.alias("rest")).withColumn(
        "after", F.greatest(F.col("rest") - square, F.lit(0.0))
    )


def full_sums(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(q_text, c_text, total): the cosine of each pair."""
    asked = weights.select(F.col("text_id").alias("q_text"), "term", F.col("weight").alias("q_weight"))
    found = weights.select(F.col("text_id").alias("c_text"), "term", "weight")
    return (
        pairs.select("q_text", "c_text")
        .join(asked, "q_text")
        .join(found, ["c_text", "term"])
        .groupBy("q_text", "c_text")
        .agg(F.sum(F.col("q_weight") * F.col("weight")).alias("total"))
    )


def floors(postings: DataFrame, weights: DataFrame, wanted: DataFrame | None, depth: int) -> DataFrame:
    """(q_text, floor): a similarity that at least ``depth`` texts have; 0 where too few texts are met."""
    asked = postings.select(F.col("text_id").alias("q_text"), "term", "n_texts", F.col("weight").alias("q_weight"))
    if wanted is not None:
        asked = asked.join(wanted, "q_text", "left_semi")
    rare_first = W.partitionBy("q_text").orderBy("n_texts", "term").rowsBetween(W.unboundedPreceding, -1)
    others = F.least(F.col("n_texts") - 1, F.lit(SUMMED * depth))
    met = F.coalesce(F.sum(others).over(rare_first), F.lit(0))
    few = asked.withColumn("met", met).filter((F.col("met") < MET * depth) & (F.col("n_texts") > 1))
    heaviest = top_per_key(postings.filter("n_texts > 1").select("term", F.col("text_id").alias("c_text"), "weight"), ["term"], [F.desc("weight"), F.asc("c_text")], SUMMED * depth, "place", lanes=256)
    partial = few.join(heaviest.drop("place"), "term").groupBy("q_text", "c_text").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("partial"))
    best = top_per_key(partial, ["q_text"], [F.desc("partial"), F.asc("c_text")], SUMMED * depth, "place")
    own = asked.select("q_text", F.col("q_text").alias("c_text")).distinct()
    summed = full_sums(best.select("q_text", "c_text").unionByName(own).distinct(), weights)
    last = top_per_key(summed, ["q_text"], [F.desc("total"), F.asc("c_text")], depth, "place").filter(F.col("place") == depth)
    return asked.select("q_text").distinct().join(last.select("q_text", F.col("total").alias("floor")), "q_text", "left").select(
        "q_text", F.coalesce("floor", F.lit(0.0)).alias("floor")
    )


def candidate_terms(postings: DataFrame, floor: DataFrame) -> DataFrame:
    """(q_text, c_text, floor, part, bound): a row for each term by which a pair may reach the floor.

    ``part`` is what the term adds, ``bound`` what the terms after it can add.
    """
    reach = F.col("floor") - MARGIN
    needed = F.when(reach > 0, reach * reach / F.col("rest")).otherwise(F.lit(0.0))
    asked = (
        postings.join(floor.withColumnRenamed("q_text", "text_id"), "text_id")
        .withColumn("needed", needed)
        .filter(F.col("needed") <= 1 + MARGIN)
        .select(
            F.col("text_id").alias("q_text"), "floor", "needed", "term", F.col("weight").alias("q_weight"), F.col("after").alias("q_after"),
            F.explode(F.sequence(F.lit(0), _slot(F.col("needed")))).alias("slot"),
        )
    )
    found = postings.select(F.col("text_id").alias("c_text"), "term", "weight", "rest", "after", _slot(F.col("rest")).alias("slot"))
    return (
        asked.join(found, ["term", "slot"])
        .filter(F.col("rest") >= F.col("needed") - MARGIN)
        .select(
            "q_text", "c_text", "floor", (F.col("q_weight") * F.col("weight")).alias("part"), F.sqrt(F.col("q_after") * F.col("after")).alias("bound")
        )
    )


def shuffled_rows(weights: DataFrame, depth: int) -> int:
    """At most about so many rows are shuffled by the steps above: those summed for floors and the pairs of all terms."""
    per_term = weights.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    made = per_term.agg(F.sum(F.col("n") * (SUMMED * depth + F.col("n"))).alias("rows")).first()["rows"]
    return int(made or 0)


def nearest_matches(weights: DataFrame, wanted: DataFrame | None, depth: int, lists: DataFrame | None = None) -> DataFrame:
    """(q_text, c_text, similarity, which may be rounded) of all texts that can be among the ``depth`` nearest of an asked text.

    ``lists`` are the weights with one row per text. With them, pairs are shuffled up to ROWS rows only.
    """
    if lists is not None and shuffled_rows(weights, depth) > ROWS:
        return nearest_in_blocks(lists, wanted, depth).withColumnRenamed("similarity", "total")
    spark = weights.sparkSession
    folder = shared_folder(spark, "pruned", uuid.uuid4().hex)
    postings = write_table(with_remainders(weights), f"{folder}/postings")
    floor = write_table(floors(postings, weights, wanted, depth), f"{folder}/floors")
    met = candidate_terms(postings, floor).groupBy("q_text", "c_text").agg(
        F.first("floor").alias("floor"), F.sum("part").alias("partial"), F.min("bound").alias("bound")
    )
    reaching = lambda c: F.col("partial") + F.col("bound") >= c - MARGIN
    pairs = write_table(met.filter(reaching(F.col("floor"))), f"{folder}/pairs")
    raised = top_per_key(pairs.select("q_text", "c_text", "partial"), ["q_text"], [F.desc("partial"), F.asc("c_text")], depth, "place")
    raised = raised.filter(F.col("place") == depth).select("q_text", F.col("partial").alias("raised"))
    left = pairs.join(raised, "q_text", "left").filter(reaching(F.greatest(F.col("floor"), F.coalesce("raised", F.lit(0.0)))))
    return full_sums(left, weights)
