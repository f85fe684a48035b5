"""Case table for lookups by id: a query reads the files that can hold its ids and no others.

Rows are dealt over ``lots`` by a digest of the id, whatever the spread of ids, and written partitioned by lot and
sorted by id, with a Bloom filter of the ids in every row group. A lookup names the lots of its ids, which are at
most ``lots`` numbers, so all other files are pruned when the scan is planned; in the files that stay, row groups
are skipped by the range and the Bloom filter of the ids, where these are few.

Edge cases: a null id is in no lot's answer, asked or stored; repeated ids keep all their rows and are asked
once; an unknown id has no row; a column called ``lot`` is not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.schema import CASE_COLUMNS, CASE_SCHEMA

#: As many as keep a lot's files at a few hundred megabytes; a table of 100 TB takes about 100,000.
LOTS = 256
#: Ids that go into the scan's filter as literals, where the reader tests each against the Bloom filters.
FEW_IDS = 10


def _lot(dr_no: Column, lots: int) -> Column:
    return F.pmod(F.xxhash64(dr_no), F.lit(lots)).cast("int")


def write_lookup(cases: DataFrame, path: str, lots: int = LOTS) -> None:
    keyed = cases.select(*CASE_COLUMNS, _lot(F.col("dr_no"), lots).alias("lot")).filter("dr_no is not null")
    # One task a lot's share; a lot that a hot id fills is split by the rebalancing.
    (
        keyed.hint("rebalance", "lot")
        .sortWithinPartitions("lot", "dr_no")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#dr_no", "true")
        .partitionBy("lot")
        .parquet(path)
    )


def lookup(spark: SparkSession, path: str, ids: DataFrame, lots: int = LOTS) -> DataFrame:
    """Rows of the table in ``path``, written with as many ``lots``, whose ids are among ``ids`` (``dr_no``)."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in CASE_SCHEMA.fields]
    table = spark.read.schema(", ".join([*fields, "lot int"])).parquet(path)
    asked = ids.select(F.col("dr_no").cast("long").alias("dr_no")).filter("dr_no is not null").distinct()
    # Numbers of lots only, at most ``lots`` of them.
    wanted = [r["lot"] for r in asked.select(_lot(F.col("dr_no"), lots).alias("lot")).distinct().collect()]
    near = table.filter(F.col("lot").isin(wanted)) if wanted else table.limit(0)
    few = [r["dr_no"] for r in asked.limit(FEW_IDS + 1).collect()]
    if 0 < len(few) <= FEW_IDS:
        return near.filter(F.col("dr_no").isin(few)).drop("lot")
    return near.drop("lot").join(asked, "dr_no", "left_semi")
