"""The two dashboard reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.operators import analytics as an
from caselink.sources.scratch import write_table

IDENTITY_THEFT = "THEFT OF IDENTITY"


def metrics_report(cases: DataFrame, category: str = IDENTITY_THEFT) -> dict[str, DataFrame]:
    """Headline figures, two top-5 lists and the latest cases of one crime type."""
    return {
        "summary": an.summary_metrics(cases),
        "top_areas": an.top_areas(cases, 5),
        "top_weapons": an.top_weapons(cases, 5),
        "recent_in_category": an.recent_in_category(cases, category, 10),
    }


def headline_report(cases: DataFrame, folder: str, n: int = 5) -> DataFrame:
    """Headline figures and top lists from one read of the table: (metric, pos, name, count).

    Counts per area, weapon and crime type also carry the first and last time of their rows, so
    totals, distinct values and dates follow from the small table of counts in ``folder``.
    """
    keys = {
        "areas": F.col("area_name"),
        "weapons": F.coalesce("weapon_desc", F.lit(an.UNKNOWN_WEAPON)),
        "crime_types": F.col("crm_cd_desc"),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), k.alias("key")) for m, k in keys.items()])
    counted = write_table(
        cases.select("datetime", F.inline(pairs))
        .groupBy("metric", "key")
        .agg(F.count(F.lit(1)).alias("count"), F.min("datetime").alias("low"), F.max("datetime").alias("high")),
        folder,
    )
    distinct = lambda m: F.count(F.when(F.col("metric") == m, F.col("key")))
    span = F.floor((F.unix_micros(F.max("high").cast("timestamp")) - F.unix_micros(F.min("low").cast("timestamp"))) / 86_400_000_000)
    figures = counted.agg(
        F.sum(F.when(F.col("metric") == "areas", F.col("count"))).alias("total_cases"),
        distinct("areas").alias("distinct_areas"),
        distinct("crime_types").alias("crime_types"),
        F.coalesce(span, F.lit(0)).cast("long").alias("time_span_days"),
        an.day_text(F.min("low")).alias("min_date"),
        an.day_text(F.max("high")).alias("max_date"),
    )
    entry = lambda i, name, count, text: F.struct(
        F.lit("summary").alias("metric"), F.lit(i).alias("pos"), text.alias("name"), count.cast("long").alias("count")
    )
    numbers = [entry(i, c, F.coalesce(F.col(c), F.lit(0)), F.lit(c)) for i, c in enumerate(("total_cases", "distinct_areas", "crime_types", "time_span_days"))]
    dates = [entry(4 + i, c, F.lit(None), F.concat(F.lit(f"{c} "), F.col(c))) for i, c in enumerate(("min_date", "max_date"))]
    report = figures.select(F.inline(F.array(*numbers, *dates)))
    for metric in ("areas", "weapons"):
        order = W.orderBy(F.desc("count"), F.asc("key"))
        top = counted.filter((F.col("metric") == metric) & F.col("key").isNotNull()).withColumn("pos", F.row_number().over(order) - 1)
        report = report.unionByName(
            top.filter(F.col("pos") < n).select(F.lit(f"top_{metric}").alias("metric"), "pos", F.col("key").alias("name"), "count")
        )
    return report


def analytics_report(cases: DataFrame, folder: str, n: int = 10) -> DataFrame:
    """All charts from one read of the table: (metric, pos, name, count).

    The counts are written to ``folder`` and the charts are cut from that small table.
    """
    return charts(write_table(chart_counts(cases), folder), n)


def chart_counts(cases: DataFrame, *by: str) -> DataFrame:
    """(*by, metric, key, count): how many cases each mark of each chart stands for, per value of the columns ``by``.

    Every case yields one (metric, key) pair per chart. The pairs are counted map-side, so the
    shuffle carries distinct keys only.
    """
    keys = {
        "monthly_trend": F.date_format("datetime", "yyyy-MM"),
        "top_areas": F.col("area_name"),
        "top_weapons": F.coalesce("weapon_desc", F.lit(an.UNKNOWN_WEAPON)),
        "age_groups": an.age_bin(F.col("vict_age")).cast("string"),
        "sex_breakdown": F.coalesce("vict_sex", F.lit(an.UNKNOWN_SEX)),
        "day_of_week": F.weekday("datetime").cast("string"),
        "hour_of_day": F.hour("datetime").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), k.alias("key")) for m, k in keys.items()])
    rows = cases.select(*by, F.inline(pairs)).filter(F.col("key").isNotNull())
    return rows.groupBy(*by, "metric", "key").agg(F.count(F.lit(1)).alias("count"))


def charts(counted: DataFrame, n: int = 10) -> DataFrame:
    """The charts of (metric, key, count), which is read once per chart."""

    def of(metric: str, key=F.col("key"), name: str = "name") -> DataFrame:
        return counted.filter(F.col("metric") == metric).select(key.alias(name), "count")

    def by_count(metric: str, limit: int | None = None) -> DataFrame:
        order = W.orderBy(F.desc("count"), F.asc("name"))
        rows = of(metric).withColumn("pos", F.row_number().over(order) - 1)
        return rows if limit is None else rows.filter(F.col("pos") < limit)

    position = F.col("key").cast("int")
    months = an.fill_months(of("monthly_trend", F.to_date("key", "yyyy-MM"), "start"))
    hours = of("hour_of_day", position, "pos")
    by_month = of("monthly_trend", F.to_date("key", "yyyy-MM"), "start")
    years = by_month.select(F.year("start").alias("year")).distinct()
    year_axis = years.withColumn("first", (F.row_number().over(W.orderBy("year")) - 1) * 12).select(
        "year", "first", F.posexplode(F.array(*[F.lit(m) for m in an.MONTHS])).alias("at", "month")
    )
    by_year = year_axis.join(
        by_month.select(F.year("start").alias("year"), (F.month("start") - 1).alias("at"), "count"), ["year", "at"], "left"
    )
    charts = {
        "monthly_trend": months.select(
            F.col("month").alias("name"), "count", (F.row_number().over(W.orderBy("month")) - 1).alias("pos")
        ),
        "top_areas": by_count("top_areas", n),
        "top_weapons": by_count("top_weapons", n),
        "age_groups": an.onto_axis(of("age_groups", position, "pos"), [b[0] for b in an.AGE_BINS]),
        "sex_breakdown": by_count("sex_breakdown"),
        "day_of_week": an.onto_axis(of("day_of_week", position, "pos"), an.WEEKDAYS),
        "hour_of_day": hours.withColumn("name", F.col("pos").cast("string")),
        "yoy_trend": by_year.select(
            (F.col("first") + F.col("at")).alias("pos"),
            F.concat_ws(" ", "month", F.col("year").cast("string")).alias("name"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        ),
    }
    report = None
    for metric, chart in charts.items():
        rows = chart.select(F.lit(metric).alias("metric"), F.col("pos").cast("int").alias("pos"), "name", "count")
        report = rows if report is None else report.unionByName(rows)
    return report
