"""Precision, recall, F1, NDCG and MAP at k of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.functions import metrics as m
from caselink.functions.pairs import is_relevant
from caselink.operators.analytics import with_same_crime_count
from caselink.operators.ensemble import Ensemble, evaluated_pool, score, score_order
from caselink.operators.linkage import Relevance, with_features, with_label
from caselink.operators.similarity import similar_cases, similar_lists
from caselink.operators.skew import heavy_keys, spread_join
from caselink.sources.text_index import TextIndex

K_VALUES = (1, 3, 5, 10, 15, 20)


def relevance_lists(ranked: DataFrame, relevance: Relevance = is_relevant) -> DataFrame:
    """(dr_no, k, rels): the labels of each (base, k) list in rank order."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "label")))
    return (
        with_label(ranked, relevance)
        .groupBy(F.col("base.dr_no").alias("dr_no"), "k")
        .agg(pairs.alias("pairs"))
        .select("dr_no", "k", F.transform("pairs", lambda p: p["label"]).alias("rels"))
    )


def labelled(lists: DataFrame, relevance: Relevance = is_relevant) -> DataFrame:
    """(dr_no, crm_cd, rels) of (base, hits) lists; labels are set inside the list, no shuffle."""
    labels = F.transform("hits", lambda hit: relevance(F.col("base"), hit["cand"]).cast("int"))
    return lists.select("base.dr_no", "base.crm_cd", _or_empty(labels).alias("rels"))


def _or_empty(rels: Column) -> Column:
    return F.coalesce(rels, F.array().cast("array<int>"))


def _each(k_values: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in k_values])).alias("k")


def metrics_at_k(lists: DataFrame, k_max: int) -> DataFrame:
    """(dr_no, k, precision, recall, f1, ndcg) of (dr_no, same_crime_count, k, rels) lists."""
    precision = m.precision(F.col("rels"), F.col("k"))
    recall = m.recall(F.col("rels"), F.col("same_crime_count"))
    return (
        lists.select("dr_no", "k", "rels", precision.alias("precision"), recall.alias("recall"))
        .select(
            "dr_no",
            "k",
            "precision",
            "recall",
            m.f1(F.col("precision"), F.col("recall")).alias("f1"),
            m.ndcg(F.col("rels"), k_max).alias("ndcg"),
        )
    )


def mean_metrics(per_case: DataFrame) -> DataFrame:
    """(k, precision, recall, f1, ndcg): means over the bases."""
    names = ("precision", "recall", "f1", "ndcg")
    return per_case.groupBy("k").agg(*[F.avg(n).alias(n) for n in names]).orderBy("k")


def similarity_metrics(
    index: TextIndex,
    bases: DataFrame,
    cases: DataFrame,
    k_values: Sequence[int] = K_VALUES,
    relevance: Relevance = is_relevant,
    bases_are_all: bool = False,
) -> DataFrame:
    """Metrics per base and k of the similarity ranking.

    Without filters every shorter list is the head of the longest, so one retrieval serves all k.
    """
    longest = max(k_values)
    lists = similar_lists(index, bases, longest, bases_are_all=bases_are_all, how="left")
    # Counts join once per base, before there is a row for every k.
    counted = with_same_crime_count(labelled(lists, relevance), F.col("crm_cd"), cases)
    cut = counted.select("dr_no", "same_crime_count", "rels", _each(k_values))
    return metrics_at_k(cut.withColumn("rels", F.slice("rels", F.lit(1), F.col("k"))), longest)


def average_precisions(
    index: TextIndex,
    bases: DataFrame,
    k: int = 10,
    relevance: Relevance = is_relevant,
    bases_are_all: bool = False,
) -> DataFrame:
    """(dr_no, average_precision) of the similarity ranking."""
    lists = similar_lists(index, bases, k, bases_are_all=bases_are_all, how="left")
    return labelled(lists, relevance).select("dr_no", m.average_precision(F.col("rels")).alias("average_precision"))


def mean_average_precision(per_case: DataFrame) -> DataFrame:
    return per_case.agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"))


def ensemble_metrics(
    index: TextIndex,
    model: Ensemble,
    bases: DataFrame,
    cases: DataFrame,
    k_values: Sequence[int],
    relevance: Relevance = is_relevant,
) -> DataFrame:
    """Metrics per base and k of the ensemble ranking.

    The candidates of a smaller k are the head of the largest candidate list, and a score does not
    depend on the list it stands in: candidates are found and scored once, then cut for every k.
    """
    widest = max(evaluated_pool(k) for k in k_values)
    scored = score(with_features(similar_cases(index, bases, widest)), model)
    each_k = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(evaluated_pool(k)).alias("pool")) for k in k_values]))
    by_list = W.partitionBy("q_id", "k").orderBy(*score_order())
    ranked = (
        scored.withColumn("q_id", F.col("base.dr_no"))
        .withColumn("cut", each_k)
        .filter(F.col("rank") <= F.col("cut.pool"))
        .withColumn("k", F.col("cut.k"))
        .withColumn("rank", F.row_number().over(by_list))
        .filter(F.col("rank") <= F.col("k"))
    )
    counted = with_same_crime_count(bases.select("dr_no", "crm_cd"), F.col("crm_cd"), cases)
    lists = (
        counted.select("dr_no", "same_crime_count", _each(k_values))
        .join(relevance_lists(ranked, relevance), ["dr_no", "k"], "left")
        .withColumn("rels", _or_empty(F.col("rels")))
    )
    return metrics_at_k(lists, max(k_values))


RULE_FIELDS = ("crm_cd", "area_name", "weapon_desc", "mo_text")
# Signs of the numbers of cases that agree in each two, three and all four fields.
_SIGNS = {2: 1, 3: -2, 4: 3}


def _values_id(fields: Sequence[str]) -> Column:
    """Key of the values of ``fields``; which of them are missing shows, as the names are part of it."""
    return F.md5(F.to_json(F.struct(*fields)))


def with_relevant_count(df: DataFrame, cases: DataFrame) -> DataFrame:
    """``df``, which has the columns of a case, with ``relevant``: how many other cases are relevant to it.

    The counterpart of ``is_relevant`` without pairing cases. Of the numbers of cases that agree in each two,
    three and all four of ``RULE_FIELDS``, those in two are added, those in three taken away twice, those in
    four added three times; every case that agrees in two or more is then counted once. A missing value agrees
    with nothing. Cases are counted by their four values first, so a frequent value costs no more than a rare
    one, and all sets of fields are counted from that in one aggregation. ``df`` must come from ``cases``: a case
    is taken off its own count.
    """
    held = lambda d: d.withColumn("_text", F.md5("mo_text"))
    fields = [*RULE_FIELDS[:3], "_text"]
    combos = held(cases).groupBy(*fields).agg(F.count(F.lit(1)).alias("_n")).withColumn("_combo", _values_id(fields))
    sets = [c for size in _SIGNS for c in combinations(fields, size)]
    present = lambda c: reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in c])
    entry = lambda i, c: F.struct(F.concat(F.lit(f"{i}:"), _values_id(c)).alias("key"), F.lit(_SIGNS[len(c)]).alias("sign"))
    shown = combos.select("_combo", "_n", F.inline(F.array_compact(F.array(*[F.when(present(c), entry(i, c)) for i, c in enumerate(sets)]))))
    agreeing = shown.groupBy("key").agg((F.sum("_n") - 1).alias("others"))
    relevant = shown.join(agreeing, "key").groupBy("_combo").agg(F.sum(F.col("sign") * F.col("others")).alias("relevant"))
    heavy = heavy_keys(combos, "_combo", "_n")
    keyed = held(df).withColumn("_combo", _values_id(fields)).drop("_text")
    found = spread_join(keyed, relevant, "_combo", heavy, "dr_no", "left").drop("_combo")
    return found.withColumn("relevant", F.coalesce("relevant", F.lit(0)))


def true_recalls(
    index: TextIndex, bases: DataFrame, cases: DataFrame, k_values: Sequence[int] = K_VALUES, bases_are_all: bool = False
) -> DataFrame:
    """(dr_no, k, recall): relevant cases among the first ``k`` over all relevant cases; 0 where there are none."""
    lists = similar_lists(index, bases, max(k_values), bases_are_all=bases_are_all, how="left")
    labels = F.transform("hits", lambda hit: is_relevant(F.col("base"), hit["cand"]))
    rows = with_relevant_count(lists.select("base.*", _or_empty(labels).alias("rels")), cases)
    cut = rows.select("dr_no", "relevant", "rels", _each(k_values))
    hits = m.found(F.slice("rels", F.lit(1), F.col("k")))
    return cut.select("dr_no", "k", F.when(F.col("relevant") > 0, hits / F.col("relevant")).otherwise(F.lit(0.0)).alias("recall"))


def compare(base: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Mean metrics of both rankings side by side per k."""
    names = ("precision", "recall", "ndcg")
    left = base.select("k", *[F.col(n).alias(f"base_{n}") for n in names])
    right = ensemble.select("k", *[F.col(n).alias(f"ensemble_{n}") for n in names])
    order = ["k"] + [f"{side}_{n}" for n in names for side in ("base", "ensemble")]
    return left.join(right, "k").select(*order).orderBy("k")
