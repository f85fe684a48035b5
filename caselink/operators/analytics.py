"""Counts, top-n lists, trends and lookups over a case table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselink.operators.skew import heavy_keys, spread_join

# Age bins (lower bound included, upper excluded) and the names of the report rows.
AGE_BINS = (
    ("0-17", 0, 18),
    ("18-29", 18, 30),
    ("30-44", 30, 45),
    ("45-59", 45, 60),
    ("60-79", 60, 80),
    ("80+", 80, 120),
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

UNKNOWN_WEAPON = "UNKNOWN"
UNKNOWN_SEX = "Unknown"


def _dimension(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(pos, name) rows of a fixed report axis."""
    axis = F.array(*[F.lit(n) for n in names])
    return df.sparkSession.range(1).select(F.posexplode(axis).alias("pos", "name"))


def count_by(df: DataFrame, value: Column, n: int | None = None) -> DataFrame:
    """Rows per non-null value, most frequent first and names ascending on equal counts."""
    counts = (
        df.select(value.alias("name"))
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("name"))
    )
    return counts if n is None else counts.limit(n)


def onto_axis(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts (pos, count) on every row (pos, name) of the axis, 0 where there is none."""
    return (
        _dimension(counts, names)
        .join(counts, "pos", "left")
        .select("pos", "name", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    )


def summary_metrics(cases: DataFrame) -> DataFrame:
    """One row: cases, areas, crime types, days spanned, first and last day.

    The table is reduced to one row per (area, crime type) before anything is counted distinct.
    """
    by_pair = cases.groupBy("area_name", "crm_cd_desc").agg(
        F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last")
    )
    micros = F.timestamp_diff("MICROSECOND", F.min("first"), F.max("last"))
    return by_pair.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_cases"),
        F.count_distinct("area_name").alias("distinct_areas"),
        F.count_distinct("crm_cd_desc").alias("crime_types"),
        F.coalesce(F.floor(micros / F.lit(86_400_000_000)), F.lit(0)).cast("long").alias("time_span_days"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("max_date"),
    )


def top_areas(cases: DataFrame, n: int = 5) -> DataFrame:
    return count_by(cases, F.col("area_name"), n)


def top_weapons(cases: DataFrame, n: int = 5) -> DataFrame:
    return count_by(cases, F.coalesce("weapon_desc", F.lit(UNKNOWN_WEAPON)), n)


def top_crime_types(cases: DataFrame, n: int = 10) -> DataFrame:
    return count_by(cases, F.col("crm_cd_desc"), n)


def recent_in_category(cases: DataFrame, category: str, n: int = 10) -> DataFrame:
    """The latest ``n`` cases of one crime type."""
    return (
        cases.filter(F.col("crm_cd_desc") == category)
        .orderBy(F.desc("datetime"), F.asc("dr_no"))
        .limit(n)
        .select(
            "dr_no",
            day_text(F.col("datetime")).alias("datetime"),
            "area_name",
            "weapon_desc",
            F.col("vict_age").cast("int").alias("vict_age"),
            "vict_sex",
        )
    )


def day_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def monthly_trend(cases: DataFrame) -> DataFrame:
    """Cases per month from the first to the last month, months without cases included."""
    counts = (
        cases.filter(F.col("datetime").isNotNull())
        .groupBy(F.trunc("datetime", "month").alias("start"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return fill_months(counts).orderBy("month")


def fill_months(counts: DataFrame) -> DataFrame:
    """(start, count) of some months -> (month, count) of every month between the outer ones."""
    span = F.sequence(F.min("start"), F.max("start"), F.expr("interval 1 month"))
    months = counts.agg(span.alias("months")).select(F.explode("months").alias("start"))
    return months.join(counts, "start", "left").select(
        F.date_format("start", "yyyy-MM").alias("month"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def age_bin(age: Column) -> Column:
    """Position of the bin that holds ``age``, null outside all bins."""
    pos = F.lit(None).cast("int")
    for i, (_, low, high) in reversed(list(enumerate(AGE_BINS))):
        pos = F.when((age >= low) & (age < high), F.lit(i)).otherwise(pos)
    return pos


def age_groups(cases: DataFrame) -> DataFrame:
    counts = (
        cases.select(age_bin(F.col("vict_age")).alias("pos"))
        .filter(F.col("pos").isNotNull())
        .groupBy("pos")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return onto_axis(counts, [name for name, _, _ in AGE_BINS]).orderBy("pos").drop("pos")


def sex_breakdown(cases: DataFrame) -> DataFrame:
    return count_by(cases, F.coalesce("vict_sex", F.lit(UNKNOWN_SEX)))


def with_share(counts: DataFrame) -> DataFrame:
    """Add each count's share of the total."""
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def day_of_week(cases: DataFrame) -> DataFrame:
    counts = (
        cases.filter(F.col("datetime").isNotNull())
        .groupBy(F.weekday("datetime").alias("pos"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return onto_axis(counts, WEEKDAYS).orderBy("pos").drop("pos")


def hour_of_day(cases: DataFrame) -> DataFrame:
    """Cases per hour; hours without cases do not appear."""
    return (
        cases.filter(F.col("datetime").isNotNull())
        .groupBy(F.hour("datetime").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("name")
    )


def yoy_trend_long(cases: DataFrame) -> DataFrame:
    """(month, year, count) for twelve months of every year that has cases."""
    counts = (
        cases.filter(F.col("datetime").isNotNull())
        .groupBy(F.year("datetime").alias("year"), F.month("datetime").alias("month_num"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    names = F.array(*[F.lit(m) for m in MONTHS])
    grid = (
        counts.select("year")
        .distinct()
        .select("year", F.posexplode(names).alias("pos", "month"))
        .withColumn("month_num", F.col("pos") + 1)
    )
    return (
        grid.join(counts, ["year", "month_num"], "left")
        .select("month_num", "month", "year", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
        .orderBy("month_num", "year")
    )


def yoy_trend(cases: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Twelve rows, one column per year. Naming ``years`` saves the look-up of the years present."""
    long = yoy_trend_long(cases)
    grouped = long.groupBy("month_num", "month")
    pivoted = grouped.pivot("year", list(years)) if years else grouped.pivot("year")
    return pivoted.agg(F.first("count")).orderBy("month_num").drop("month_num").na.fill(0)


def with_same_crime_count(rows: DataFrame, code: Column, cases: DataFrame) -> DataFrame:
    """Add ``same_crime_count``: how many cases have the crime code; 0 without a code.

    Crime codes are few, so the rows of each are dealt over lanes; ``rows`` needs a ``dr_no`` for that.
    """
    counts = (
        cases.filter(F.col("crm_cd").isNotNull())
        .groupBy(F.col("crm_cd").alias("_code"))
        .agg(F.count(F.lit(1)).alias("same_crime_count"))
    )
    heavy = heavy_keys(counts, "_code", "same_crime_count")
    return (
        spread_join(rows.withColumn("_code", code), counts, "_code", heavy, "dr_no", "left")
        .drop("_code")
        .withColumn("same_crime_count", F.coalesce("same_crime_count", F.lit(0)).cast("long"))
    )


def same_crime_counts(cases: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(dr_no, same_crime_count) of every base."""
    rows = (cases if bases is None else bases).select("dr_no", "crm_cd")
    return with_same_crime_count(rows, F.col("crm_cd"), cases).drop("crm_cd")


def search_case_ids(cases: DataFrame, pattern: str, n: int = 10) -> DataFrame:
    """The first ids whose digits match the regular expression; an empty pattern finds nothing."""
    ids = cases.select("dr_no")
    if not pattern:
        return ids.limit(0)
    return ids.filter(F.col("dr_no").cast("string").rlike(pattern)).orderBy("dr_no").limit(n)


def lookup_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Case rows of the asked ids; an unknown id has no row."""
    return cases.join(ids.select("dr_no").distinct(), "dr_no", "left_semi")


def case_detail(cases: DataFrame) -> DataFrame:
    return cases.select(
        "dr_no",
        day_text(F.col("datetime")).alias("datetime"),
        "area_name",
        F.col("crm_cd").cast("int").alias("crm_cd"),
        "crm_cd_desc",
        "weapon_desc",
        F.col("vict_age").cast("int").alias("vict_age"),
        "vict_sex",
        "mo_text",
    )
