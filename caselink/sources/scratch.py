"""Shared folder for tables that a job writes and reads back."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_FOLDER_SETTING = "spark.checkpoint.dir"
# This library's own setting; set by it in local runs that name no shared folder.
_LOCAL_SETTING = "spark.caselink.dir"


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """Folder of this application under the one the cluster names in ``spark.checkpoint.dir``."""
    root = spark.conf.get(_FOLDER_SETTING, None) or spark.conf.get(_LOCAL_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_FOLDER_SETTING} to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="caselink-")
        spark.conf.set(_LOCAL_SETTING, root)
    app = f"{root.rstrip('/')}/caselink-{spark.sparkContext.applicationId}"
    return "/".join([app, *parts])


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and return the table, cut off from the plan that made it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
