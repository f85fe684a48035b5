"""Train, explain and evaluate in one go."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from caselink.operators import ensemble, evaluation, linkage
from caselink.schema import FEATURES
from caselink.sources import models
from caselink.sources.scratch import write_table
from caselink.sources.text_index import TextIndex, table_fingerprint

# The two settings in which the evaluation is run.
OFFLINE = {"eval_cases": 30, "k_values": (1, 3, 5, 10)}
SERVED = {"eval_cases": 15, "k_values": (5, 10)}
TRAINING_CASES = 1000


@dataclass(frozen=True)
class EvaluationRun:
    model: ensemble.Ensemble
    label_rate: DataFrame
    importances: DataFrame
    comparison: DataFrame


def trained(
    index: TextIndex | Callable[[], TextIndex],
    cases: DataFrame,
    folder: str,
    n: int = TRAINING_CASES,
    trees: int = ensemble.TREES,
    reuse: bool = True,
    apart: bool = False,
    version: str | None = None,
) -> ensemble.Ensemble:
    """The ensemble saved below ``folder``, trained on ``n`` sampled bases if there is none.

    The model's folder carries the fingerprint of cases and settings; a caller who knows the table's
    ``version`` saves the pass that takes it. ``index`` may be a function that provides the index; it is called
    only to train. ``apart`` trains on cases whose texts are not held out (``linkage.held_out``).
    """
    return _trained_at(model_folder(cases, folder, n, trees, apart, version), index, cases, n, trees, reuse, apart)


def _trained_at(
    folder: str, index: TextIndex | Callable[[], TextIndex], cases: DataFrame, n: int, trees: int, reuse: bool, apart: bool
) -> ensemble.Ensemble:
    spark = cases.sparkSession

    def fit() -> ensemble.Ensemble:
        texts = index() if callable(index) else index
        pairs = write_table(linkage.training_pairs(texts, cases, n, apart=apart), f"{folder}/pairs")
        # n bases have at most 15 pairs each: a handful of tasks is enough for any table.
        tasks = max(1, min(spark.sparkContext.defaultParallelism, n * linkage.TRAINING_K // 2000))
        return ensemble.train(pairs, trees=trees, partitions=tasks)

    if reuse:
        return models.load_or_train(spark, f"{folder}/model", fit)
    model = fit()
    models.save(model, f"{folder}/model", spark)
    return model


def model_folder(
    cases: DataFrame, folder: str, n: int = TRAINING_CASES, trees: int = ensemble.TREES, apart: bool = False, version: str | None = None
) -> str:
    """Where the model of these cases and settings, and the pairs it was trained on, lie."""
    settings = f"{n}:{trees}:{linkage.SAMPLE_SEED}:{FEATURES}" + (":apart" if apart else "")
    named = hashlib.md5(f"{version}:{settings}".encode()).hexdigest() if version else table_fingerprint(cases, settings)
    return f"{folder}/{named}"


def compare_rankings(
    index: TextIndex,
    cases: DataFrame,
    model: ensemble.Ensemble,
    eval_cases: int = OFFLINE["eval_cases"],
    k_values: Sequence[int] = OFFLINE["k_values"],
    apart: bool = False,
) -> DataFrame:
    """Similarity against ensemble on sampled cases.

    The sample for evaluation and that for training are drawn in one order, so its cases were trained on;
    ``apart`` draws it from the cases whose texts are held out, for a model that was trained ``apart``.

    The labels restate features the ensemble is given, so its scores show that it has learnt the
    labelling rule and say nothing about linked cases.
    """
    bases = linkage.stored_sample(cases.filter(linkage.held_out()) if apart else cases, eval_cases)
    plain = evaluation.similarity_metrics(index, bases, cases, k_values)
    learnt = evaluation.ensemble_metrics(index, model, bases, cases, k_values)
    return evaluation.compare(evaluation.mean_metrics(plain), evaluation.mean_metrics(learnt))


def run_evaluation(
    index: TextIndex,
    cases: DataFrame,
    folder: str,
    n: int = TRAINING_CASES,
    eval_cases: int = OFFLINE["eval_cases"],
    k_values: Sequence[int] = OFFLINE["k_values"],
    trees: int = ensemble.TREES,
    apart: bool = False,
    version: str | None = None,
) -> EvaluationRun:
    """Train afresh, then importances and the comparison of both rankings; ``apart`` as in ``compare_rankings``."""
    # Named once: without a version the name costs a pass over the cases.
    folder = model_folder(cases, folder, n, trees, apart, version)
    model = _trained_at(folder, index, cases, n, trees, False, apart)
    pairs = cases.sparkSession.read.parquet(f"{folder}/pairs")
    return EvaluationRun(
        model,
        linkage.label_rate(pairs),
        ensemble.importances(model, cases.sparkSession),
        compare_rankings(index, cases, model, eval_cases, k_values, apart),
    )
