"""The store by day and the table for lookups by id."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselink.operators import prepare
from caselink.plans import daily, reports
from caselink.sources import lookup

START = dt.datetime(2024, 1, 30, 9)


def rows_of_days(days, each=4, weapon="GUN", first_id=0):
    return [
        {
            "dr_no": first_id + 100 * d + i,
            "datetime": START + dt.timedelta(days=d, hours=i),
            "area_name": f"A{(d + i) % 3}",
            "weapon_desc": weapon,
            "crm_cd_desc": f"C{i}",
            "vict_age": 10 * i,
            "mo_text": f"text {d} {i}",
        }
        for d in days
        for i in range(each)
    ]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def scanned(df, metric):
    """Sum of a metric over the file scans of ``df`` after a run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply(metric).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("grain", ["day", "month"])
def test_report_after_a_late_part_equals_the_report_of_the_table(spark, make_cases, tmp_path, grain):
    path = str(tmp_path / "store")
    no_time = [{"dr_no": 7777, "area_name": "A1"}]
    daily.replace(make_cases(*rows_of_days(range(6), weapon=None), *no_time), path, grain)
    late = range(2, 4) if grain == "day" else range(2, 6)
    for _ in range(2):
        daily.replace(make_cases(*rows_of_days(late, each=5)), path, grain)
    daily.replace(make_cases(), path, grain)
    early = [d for d in range(6) if d not in late]
    whole = make_cases(*rows_of_days(early, weapon=None), *rows_of_days(late, each=5), *no_time)
    expected = found(reports.analytics_report(whole, str(tmp_path / "a")))
    assert found(daily.analytics_report(spark, path, str(tmp_path / "b"), grain=grain)) == expected

    part = whole.filter("datetime >= '2024-02-01' and datetime < '2024-02-03'")
    between = daily.analytics_report(spark, path, str(tmp_path / "c"), "2024-02-01", "2024-02-02", grain=grain)
    assert found(between) == found(reports.analytics_report(part, str(tmp_path / "d")))

    got = daily.summary(spark, path, grain=grain).first()
    n = whole.count()
    assert tuple(got) == (n, 3, 5, n, n - 1, "2024-01-30", "2024-02-04")
    assert daily.summary(spark, path, "2030-01-01", grain=grain).first()["total_cases"] == 0
    for k in (0, 1, 7, n - 1, 1000):
        latest = found(daily.latest_cases(spark, path, k))
        assert latest == found(prepare.recent_cases(whole.filter("datetime is not null"), k))


def test_only_the_days_asked_for_are_read(spark, make_cases, tmp_path):
    path = str(tmp_path / "store")
    daily.replace(make_cases(*rows_of_days(range(8))), path)
    counts = daily._between(daily.read(spark, path, "counts"), "2024-02-01", "2024-02-02", "day")
    assert "PartitionFilters: [isnotnull(period" in counts._jdf.queryExecution().executedPlan().toString()
    assert scanned(counts, "numFiles") < scanned(daily.read(spark, path, "counts"), "numFiles") / 2


def test_sketches_count_within_two_percent(spark, tmp_path):
    path = str(tmp_path / "store")
    ids = spark.range(60_000)
    many = ids.select(
        F.col("id").alias("dr_no"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_interval(days=F.col("id").cast("int") % 3)).alias("datetime"),
        *[F.lit(None).cast("string").alias(c) for c in ("area_name", "crm_cd_desc", "weapon_desc", "vict_sex")],
        *[F.lit(None).cast("int").alias(c) for c in ("crm_cd", "vict_age")],
        (F.col("id") % 20_000).cast("string").alias("mo_text"),
    )
    daily.replace(many, path)
    got = daily.summary(spark, path).first()
    assert got["total_cases"] == 60_000 and got["distinct_areas"] == 0
    assert abs(got["distinct_ids"] - 60_000) < 1_200
    # Every day has other texts or the same ones: sketches merge, they do not add up.
    assert abs(got["distinct_texts"] - 20_000) < 400


def test_lookup_gives_the_rows_of_the_ids(spark, make_cases, tmp_path):
    path = str(tmp_path)
    rows = rows_of_days(range(30)) + rows_of_days([3])
    cases = make_cases(*rows)
    lookup.write_lookup(cases, path, lots=16)
    for wanted in ([], [None], [5], [300, 300, None], [0, 1, 2, 101, -4], list(range(0, 3000, 7))):
        ids = spark.createDataFrame([(i,) for i in wanted], "dr_no long")
        expected = found(cases.join(ids.dropna().distinct(), "dr_no", "left_semi"))
        assert found(lookup.lookup(spark, path, ids, lots=16)) == expected


def test_lookup_of_one_id_reads_the_files_of_its_lot(spark, make_cases, tmp_path):
    path = str(tmp_path)
    lookup.write_lookup(make_cases(*rows_of_days(range(40))), path, lots=16)
    files = scanned(spark.read.parquet(path), "numFiles")
    one = lookup.lookup(spark, path, spark.createDataFrame([(301,)], "dr_no long"), lots=16)
    assert files >= 16 and scanned(one, "numFiles") <= files / 8


def test_empty_lookup_table(spark, make_cases, tmp_path):
    lookup.write_lookup(make_cases(), str(tmp_path))
    assert lookup.lookup(spark, str(tmp_path), spark.range(3).withColumnRenamed("id", "dr_no")).count() == 0
