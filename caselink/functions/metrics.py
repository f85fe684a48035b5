"""Ranking metrics over ``rels``: an array of 0/1 labels in rank order, at most k long."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Share of the cases with the same crime code that the recall estimate takes for relevant.
RELEVANT_SHARE = 0.3


def found(rels: Column) -> Column:
    return F.aggregate(rels, F.lit(0), lambda acc, r: acc + r)


def precision(rels: Column, k: Column) -> Column:
    """Relevant rows over k, also when fewer than k rows were retrieved."""
    return found(rels) / k


def recall(rels: Column, same_crime_count: Column) -> Column:
    hits = found(rels)
    expected = F.greatest(same_crime_count * F.lit(RELEVANT_SHARE), hits.cast("double"))
    return F.when((F.size(rels) > 0) & (expected > 0), hits / expected).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def ndcg(rels: Column, k_max: int) -> Column:
    """Gain of the list over the gain of the same list with the relevant rows moved up."""
    discounts = [1 / math.log2(i + 2) for i in range(k_max)]
    ideal = [sum(discounts[:n]) for n in range(k_max + 1)]
    gain = F.aggregate(
        F.transform(rels, lambda r, i: r / F.log2(i + 2)), F.lit(0.0), lambda acc, g: acc + g
    )
    hits = found(rels)
    best = F.element_at(F.array(*[F.lit(v) for v in ideal]), hits + 1)
    return F.when(hits > 0, gain / best).otherwise(F.lit(0.0))


def average_precision(rels: Column) -> Column:
    """Mean over the relevant rows found of the precision at their rank; 0 if none."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("total"), F.lit(0).alias("rank"))

    def step(acc: Column, r: Column) -> Column:
        hits = acc["hits"] + r
        rank = acc["rank"] + 1
        return F.struct(
            hits.alias("hits"),
            (acc["total"] + F.when(r == 1, hits / rank).otherwise(0.0)).alias("total"),
            rank.alias("rank"),
        )

    return F.aggregate(
        rels,
        start,
        step,
        lambda acc: F.when(acc["hits"] > 0, acc["total"] / acc["hits"]).otherwise(F.lit(0.0)),
    )
