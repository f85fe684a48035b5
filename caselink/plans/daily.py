"""Case store by day: cases, counts and sketches of each day, replaced a period at a time.

Three tables are partitioned by the period (a day, month or year, as ``grain`` says; null without a time) of a case:
``cases``; ``counts``, what each mark of each chart stands for per day; and ``days``, one row a day with its number
of cases, first and last time, and mergeable sketches for distinct counts. A part that comes late replaces just the
periods it has rows of, by dynamic partition overwrite, so a repeated or interrupted ``replace`` can be run
again with the same result. Reports sum the small tables and read only the periods asked for; the latest n cases
read the periods that hold them. A store keeps the grain it was begun with.

Edge cases: a period that is not in a part stays as it was, so none can be emptied this way; an empty part
changes nothing; cases without a time are a period of their own, found in reports over all days only; columns
other than those of a case are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.operators import prepare
from caselink.operators.analytics import day_text
from caselink.plans import reports
from caselink.schema import CASE_COLUMNS, CASE_SCHEMA
from caselink.sources.scratch import write_table

#: 2^14 registers: a standard error of 0.7 %; up to some thousand values the sketch holds them all.
SKETCH_BITS = 14
#: Columns whose distinct values are sketched.
SKETCHED = ("area_name", "crm_cd_desc", "dr_no", "mo_text")

_DAYS = "day date, period date"
_TABLES = {
    "cases": ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in CASE_SCHEMA.fields] + [_DAYS]),
    "counts": f"metric string, key string, count bigint, {_DAYS}",
    "days": "n_cases bigint, first timestamp_ntz, last timestamp_ntz, "
    + ", ".join(f"{c}_sketch binary" for c in SKETCHED)
    + f", {_DAYS}",
}


def _replace(df: DataFrame, path: str) -> None:
    # Rebalanced by period: its rows come together in few files, those of a hot one are split over several tasks.
    (
        df.hint("rebalance", "period")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{path}/{name}")


def _period(day: Column, grain: str) -> Column:
    return day if grain == "day" else F.trunc(day, grain)


def replace(cases: DataFrame, path: str, grain: str = "day") -> None:
    """Put the periods of ``cases`` in place of what the store has of them."""
    day = F.to_date("datetime")
    dated = cases.select(*CASE_COLUMNS, day.alias("day"), _period(day, grain).alias("period"))
    # Written once beside the store, so that its three tables come from the same rows and one read of the source.
    part = write_table(dated, f"{path}/incoming")
    _replace(part, f"{path}/cases")
    _replace(reports.chart_counts(part, "day", "period"), f"{path}/counts")
    sketches = [F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(f"{c}_sketch") for c in SKETCHED]
    per_day = part.groupBy("day", "period").agg(
        F.count(F.lit(1)).alias("n_cases"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), *sketches
    )
    _replace(per_day, f"{path}/days")


def _between(table: DataFrame, first: str | None, last: str | None, grain: str) -> DataFrame:
    if first is not None:
        day = F.lit(first).cast("date")
        table = table.filter((F.col("period") >= _period(day, grain)) & (F.col("day") >= day))
    if last is not None:
        day = F.lit(last).cast("date")
        # A period begins on the day it is called by.
        table = table.filter((F.col("period") <= day) & (F.col("day") <= day))
    return table


def analytics_report(
    spark: SparkSession, path: str, folder: str, first: str | None = None, last: str | None = None, n: int = 10, grain: str = "day"
) -> DataFrame:
    """All charts of the days from ``first`` to ``last`` (yyyy-MM-dd, both included); only their counts are read."""
    counts = _between(read(spark, path, "counts"), first, last, grain)
    summed = counts.groupBy("metric", "key").agg(F.sum("count").alias("count"))
    return reports.charts(write_table(summed, folder), n)


def _distinct(column: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{column}_sketch")), F.lit(0))


def summary(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None, grain: str = "day"
) -> DataFrame:
    """One row: cases, approximate distinct areas, crime types, ids and texts, first and last day; one row a day is read.

    ``analytics.summary_metrics`` counts exactly.
    """
    return _between(read(spark, path, "days"), first, last, grain).agg(
        F.coalesce(F.sum("n_cases"), F.lit(0)).alias("total_cases"),
        _distinct("area_name").alias("distinct_areas"),
        _distinct("crm_cd_desc").alias("crime_types"),
        _distinct("dr_no").alias("distinct_ids"),
        _distinct("mo_text").alias("distinct_texts"),
        day_text(F.min("first")).alias("min_date"),
        day_text(F.max("last")).alias("max_date"),
    )


def latest_cases(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The ``n`` latest cases, by time then smallest id; reads the periods that hold them, found from the days' counts."""
    days = read(spark, path, "days").filter("day is not null")
    # One row a day, so the window over all of them is small.
    later = F.sum("n_cases").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1))
    needed = days.select("day", "period", F.coalesce(later, F.lit(0)).alias("later")).filter(F.col("later") < n)
    since = needed.agg(F.min("day").alias("day"), F.min("period").alias("period")).first()
    dated = read(spark, path, "cases")
    if since["day"] is None:
        return dated.limit(0).drop("day", "period")
    kept = dated.filter((F.col("period") >= F.lit(since["period"])) & (F.col("day") >= F.lit(since["day"])))
    return prepare.recent_cases(kept.drop("day", "period"), n)
