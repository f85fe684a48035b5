"""Saved ensembles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caselink.operators.ensemble import Ensemble


def save(model: Ensemble, path: str, spark: SparkSession) -> None:
    model.forest.write().overwrite().save(f"{path}/forest")
    model.boosting.write().overwrite().save(f"{path}/boosting")
    names = spark.range(1).select(F.array(*[F.lit(f) for f in model.features]).alias("features"))
    # Written last: its presence says that both models are whole.
    names.write.mode("overwrite").parquet(f"{path}/features")


def load(spark: SparkSession, path: str) -> Ensemble:
    features = spark.read.parquet(f"{path}/features").first()["features"]
    return Ensemble(
        RandomForestClassificationModel.load(f"{path}/forest"),
        GBTClassificationModel.load(f"{path}/boosting"),
        tuple(features),
    )


def load_or_train(spark: SparkSession, path: str, fit: Callable[[], Ensemble]) -> Ensemble:
    """The ensemble at ``path``; trained by ``fit`` and saved if no whole one is there.

    Only a missing marker means that; a fault while a whole one is read is the caller's to see.
    """
    try:
        spark.read.schema("features array<string>").parquet(f"{path}/features")
    except AnalysisException:
        model = fit()
        save(model, path, spark)
        return model
    return load(spark, path)
