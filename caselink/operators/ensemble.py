"""Random forest and gradient boosting over pair features: train, score, rank."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.operators.linkage import SAMPLE_SEED, with_features
from caselink.operators.similarity import DIGITS, dealt_cases, similar_cases
from caselink.schema import FEATURES
from caselink.sources.text_index import TextIndex

# Size of the two models.
TREES = 100
FOREST_DEPTH = 6
BOOSTING_DEPTH = 4
BOOSTING_STEP = 0.1

SERVED_K = 10
# Bases that one task ranks at once: their pairs are sorted in its memory.
BASES_PER_TASK = 10_000

# Cells whose scores are made once and sent to all tasks at most, and bounds of a feature up to which they are cut.
CELLS, BOUNDS = 1 << 20, 128


@dataclass(frozen=True)
class Ensemble:
    forest: RandomForestClassificationModel
    boosting: GBTClassificationModel
    features: tuple[str, ...]


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)


def train(
    pairs: DataFrame,
    features: Sequence[str] = FEATURES,
    trees: int = TREES,
    seed: int = SAMPLE_SEED,
    partitions: int | None = None,
) -> Ensemble:
    """Fit both models on (features..., label) rows.

    Leave ``vict_sex`` and ``vict_age`` features out by passing a shorter ``features`` list. Every
    boosting round is a few small jobs over the pairs; ``partitions`` sets how many tasks each has.
    """
    data = _vectors(pairs, features).select("_features", F.col("label").cast("double").alias("label"))
    if partitions:
        data = data.repartition(partitions)
    data = data.persist()
    try:
        labels = {r["label"] for r in data.select("label").distinct().limit(3).collect()}
        if labels != {0.0, 1.0}:
            raise ValueError(f"training needs pairs with label 0 and pairs with label 1, found {sorted(labels)}")
        shared = {"featuresCol": "_features", "labelCol": "label", "seed": seed}
        forest = RandomForestClassifier(numTrees=trees, maxDepth=FOREST_DEPTH, **shared).fit(data)
        boosting = GBTClassifier(
            maxIter=trees, maxDepth=BOOSTING_DEPTH, stepSize=BOOSTING_STEP, **shared
        ).fit(data)
    finally:
        data.unpersist()
    return Ensemble(forest, boosting, tuple(features))


def importances(model: Ensemble, spark: SparkSession) -> DataFrame:
    """(feature, rf, gb, avg), most important first."""
    rows = [
        (f, float(model.forest.featureImportances[i]), float(model.boosting.featureImportances[i]))
        for i, f in enumerate(model.features)
    ]
    return (
        spark.createDataFrame(rows, "feature string, rf double, gb double")
        .withColumn("avg", (F.col("rf") + F.col("gb")) / 2)
        .orderBy(F.desc("avg"), F.asc("feature"))
    )


def score(pairs: DataFrame, model: Ensemble, many: bool = False) -> DataFrame:
    """Add ``p_rf``, ``p_gb`` and their mean ``score`` to rows that have the features.

    ``many`` is for rows by the million: the trees then see one row of each cell (``cells``) instead of every pair.
    """
    bounds = cell_bounds(model) if many else None
    rows = _probabilities(pairs, model) if bounds is None else _looked_up(pairs, model, bounds)
    return rows.withColumn("score", (F.col("p_rf") + F.col("p_gb")) / 2)


def _probabilities(pairs: DataFrame, model: Ensemble) -> DataFrame:
    rows = _vectors(pairs, model.features)
    for part, column in ((model.forest, "p_rf"), (model.boosting, "p_gb")):
        part = part.copy().setFeaturesCol("_features").setProbabilityCol("_p")
        part = part.setRawPredictionCol("").setPredictionCol("")
        rows = part.transform(rows).withColumn(column, vector_to_array("_p")[1]).drop("_p")
    return rows.drop("_features")


def cell_bounds(model: Ensemble) -> list[list[float]] | None:
    """Of each feature, the values at which a tree of either model splits, ascending; None if they make too many cells.

    A tree goes left where a feature is at most the value of the split, so both models are constant between
    neighbouring bounds of all features.
    """
    found: list[set[float]] = [set() for _ in model.features]
    for part in (model.forest, model.boosting):
        trees = part.toDebugString
        if re.search(r"\(feature \d+ (not )?in ", trees):
            return None
        for feature, bound in re.findall(r"\(feature (\d+) <= ([^)]+)\)", trees):
            found[int(feature)].add(float(bound))
    bounds = [sorted(b) for b in found]
    few = max(map(len, bounds)) <= BOUNDS and math.prod(len(b) + 1 for b in bounds) <= CELLS
    return bounds if few else None


def cells(spark: SparkSession, model: Ensemble, bounds: list[list[float]]) -> DataFrame:
    """(_cell, p_rf, p_gb): what the models say of a row of each cell between the bounds."""
    rows = spark.range(math.prod(len(b) + 1 for b in bounds)).withColumnRenamed("id", "_cell")
    below = 1
    for feature, b in zip(model.features, bounds):
        # The highest value of the cell; above the last bound any value will do.
        values = [*b, math.nextafter(b[-1], math.inf) if b else 0.0]
        at = (F.floor(F.col("_cell") / F.lit(below)) % len(values)).cast("int")
        rows = rows.withColumn(feature, F.get(F.array(*[F.lit(v) for v in values]), at))
        below *= len(values)
    return _probabilities(rows, model).select("_cell", "p_rf", "p_gb")


def _bounds_below(value: Column, bounds: list[float], before: int = 0) -> Column:
    """How many bounds are less than ``value``, found by halving."""
    if not bounds:
        return F.lit(before)
    half = len(bounds) // 2
    lower, upper = bounds[:half], bounds[half + 1 :]
    return F.when(value <= bounds[half], _bounds_below(value, lower, before)).otherwise(_bounds_below(value, upper, before + half + 1))


def _looked_up(pairs: DataFrame, model: Ensemble, bounds: list[list[float]]) -> DataFrame:
    """``_probabilities`` by way of the ``cells``, at most CELLS rows that are sent to the pairs."""
    cell, below, unfit = F.lit(0), 1, F.lit(False)
    for feature, b in zip(model.features, bounds):
        value = F.col(feature).cast("double")
        cell = cell + _bounds_below(value, b) * below
        below *= len(b) + 1
        unfit = unfit | value.isNull() | F.isnan(value)
    # As where vectors are made of them.
    refused = F.raise_error("a feature of a pair is null or NaN").cast("int")
    rows = pairs.drop("p_rf", "p_gb").withColumn("_cell", F.when(unfit, refused).otherwise(cell).cast("long"))
    return rows.join(F.broadcast(cells(pairs.sparkSession, model, bounds)), "_cell", "left").drop("_cell")


def score_order() -> list[Column]:
    return [F.desc(F.round("score", DIGITS)), F.desc("similarity"), F.asc("cand.dr_no")]


def rank_cases(candidates: DataFrame, model: Ensemble, k: int = SERVED_K, many: bool = False) -> DataFrame:
    """Reorder (base, similarity, cand) candidates by score and keep ``k`` per base; ``many`` as in ``score``.

    A base has at most one candidate list, so the groups of the window are bounded by its length. Candidates
    are dealt by base before they are scored: the window needs that anyway, and so every task scores its share.
    """
    return _ranked(candidates.withColumn("q_id", F.col("base.dr_no")).repartition("q_id"), model, k, many)


def _ranked(dealt: DataFrame, model: Ensemble, k: int, many: bool = False) -> DataFrame:
    scored = score(with_features(dealt), model, many)
    by_base = W.partitionBy("q_id").orderBy(*score_order())
    return (
        scored.drop("rank").withColumn("rank", F.row_number().over(by_base)).filter(F.col("rank") <= k).drop("q_id")
    )


def rank_all_cases(index: TextIndex, cases: DataFrame, model: Ensemble, k: int = SERVED_K) -> DataFrame:
    """``rank_cases`` of the served pools of all cases of the index.

    Where few texts make up all cases, bases are dealt by id before they meet their lists, so that no pair is
    shuffled: a base has ``served_pool(k)`` of them, which would write many times the table.
    """
    dealt = dealt_cases(index, cases, served_pool(k), BASES_PER_TASK)
    if dealt is None:
        return rank_cases(similar_cases(index, cases, served_pool(k), bases_are_all=True), model, k, many=True)
    return _ranked(dealt, model, k, many=True)


def served_pool(k: int) -> int:
    return max(30, 3 * k)


def evaluated_pool(k: int) -> int:
    return max(20, 3 * k)


def as_served(ranked: DataFrame) -> DataFrame:
    """Flat rows of a ranking with the features that explain it as one nested value."""
    explained = F.struct(
        *[F.col(f).cast("boolean").alias(f) for f in ("area_match", "weapon_match", "crime_code_match")],
        F.col("time_decay"),
        F.col("sex_match").cast("boolean").alias("sex_match"),
        F.col("age_difference"),
    )
    return ranked.select(
        F.col("base.dr_no").alias("q_id"),
        "rank",
        "cand.dr_no",
        F.date_format("cand.datetime", "yyyy-MM-dd").alias("datetime"),
        "cand.area_name",
        "cand.crm_cd_desc",
        "cand.weapon_desc",
        "cand.vict_age",
        "cand.vict_sex",
        "similarity",
        "score",
        "cand.mo_text",
        explained.alias("features"),
    )
