from datetime import datetime

from pyspark.sql import functions as F

from caselink.operators import analytics as an
from caselink.plans import reports


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_age_bins(make_cases):
    ages = [-3, 0, 17, 18, 79, 80, 119, 120, None]
    cases = make_cases(*[{"dr_no": i, "vict_age": a} for i, a in enumerate(ages)])
    assert pairs(an.age_groups(cases)) == [
        ("0-17", 2), ("18-29", 1), ("30-44", 0), ("45-59", 0), ("60-79", 1), ("80+", 2)
    ]


def test_months_without_cases(make_cases):
    days = [(1, 5), (3, 9), (3, 31), (5, 1)]
    cases = make_cases(*[{"dr_no": i, "datetime": datetime(2024, m, d)} for i, (m, d) in enumerate(days)], {"dr_no": 9})
    assert pairs(an.monthly_trend(cases)) == [
        ("2024-01", 1), ("2024-02", 0), ("2024-03", 2), ("2024-04", 0), ("2024-05", 1)
    ]


def test_year_over_year(make_cases):
    days = [(2022, 1), (2024, 1), (2024, 1), (2024, 12)]
    cases = make_cases(*[{"dr_no": i, "datetime": datetime(y, m, 3)} for i, (y, m) in enumerate(days)])
    table = an.yoy_trend(cases)
    assert table.columns == ["month", "2022", "2024"]
    rows = pairs(table)
    assert len(rows) == 12 and rows[0] == ("Jan", 1, 2) and rows[1] == ("Feb", 0, 0) and rows[11] == ("Dec", 0, 1)
    assert pairs(an.yoy_trend(cases, [2022, 2024])) == rows


def test_weekdays_and_hours(make_cases):
    times = [datetime(2024, 1, 1, 7), datetime(2024, 1, 7, 7), datetime(2024, 1, 7, 23)]
    cases = make_cases(*[{"dr_no": i, "datetime": t} for i, t in enumerate(times)], {"dr_no": 9})
    assert [c for _, c in pairs(an.day_of_week(cases))] == [1, 0, 0, 0, 0, 0, 2]
    assert pairs(an.hour_of_day(cases)) == [(7, 2), (23, 1)]


def test_counts_and_nulls(make_cases):
    cases = make_cases(
        {"dr_no": 1, "area_name": "B", "weapon_desc": None, "vict_sex": "F"},
        {"dr_no": 2, "area_name": "A", "weapon_desc": "KNIFE"},
        {"dr_no": 3, "area_name": None, "weapon_desc": None},
    )
    assert pairs(an.top_areas(cases)) == [("A", 1), ("B", 1)]
    assert pairs(an.top_weapons(cases)) == [("UNKNOWN", 2), ("KNIFE", 1)]
    assert pairs(an.sex_breakdown(cases)) == [("Unknown", 2), ("F", 1)]
    shares = [r["share"] for r in an.with_share(an.sex_breakdown(cases)).collect()]
    assert abs(shares[0] - 2 / 3) < 1e-12


def test_summary(make_cases):
    cases = make_cases(
        {"dr_no": 1, "area_name": "A", "crm_cd_desc": "X", "datetime": datetime(2024, 1, 1, 18)},
        {"dr_no": 2, "area_name": "A", "crm_cd_desc": None, "datetime": datetime(2024, 1, 3, 6)},
        {"dr_no": 3, "area_name": None, "crm_cd_desc": "Y"},
    )
    assert tuple(an.summary_metrics(cases).first()) == (3, 1, 2, 1, "2024-01-01", "2024-01-03")
    assert tuple(an.summary_metrics(cases.limit(0)).first()) == (0, 0, 0, 0, None, None)


def test_id_search(make_cases):
    cases = make_cases(*[{"dr_no": i} for i in (9163, 212, 123)])
    assert [r["dr_no"] for r in an.search_case_ids(cases, "1.3").collect()] == [123, 9163]
    assert an.search_case_ids(cases, "").count() == 0


def test_lookup(spark, make_cases):
    cases = make_cases({"dr_no": 1, "vict_age": 3, "datetime": datetime(2024, 1, 2)}, {"dr_no": 2})
    ids = spark.createDataFrame([(1,), (1,), (77,)], "dr_no long")
    assert [(r["dr_no"], r["datetime"]) for r in an.case_detail(an.lookup_cases(cases, ids)).collect()] == [(1, "2024-01-02")]


def test_recent_in_category(make_cases):
    cases = make_cases(*[{"dr_no": i, "crm_cd_desc": "T", "datetime": datetime(2024, 1, 1 + i // 2)} for i in range(30)])
    assert [r["dr_no"] for r in an.recent_in_category(cases, "T", 3).collect()] == [28, 29, 26]
    assert an.recent_in_category(cases, "other").count() == 0


def test_same_crime_counts(make_cases):
    cases = make_cases({"dr_no": 1, "crm_cd": 5}, {"dr_no": 2, "crm_cd": 5}, {"dr_no": 3})
    assert sorted(pairs(an.same_crime_counts(cases))) == [(1, 2), (2, 2), (3, 0)]


def test_report_equals_the_single_charts(spark, make_cases, tmp_path):
    cases = make_cases(
        *[
            {
                "dr_no": i,
                "datetime": datetime(2023 + i % 2, 1 + i % 11, 1 + i % 27, i % 24),
                "area_name": f"A{i % 13:02d}",
                "weapon_desc": None if i % 3 else "W",
                "vict_age": i % 130,
                "vict_sex": None if i % 7 else "F",
            }
            for i in range(200)
        ]
    )
    report = reports.analytics_report(cases, str(tmp_path / "counts"))
    got = {}
    for r in report.orderBy("metric", "pos").collect():
        got.setdefault(r["metric"], []).append((r["name"], r["count"]))
    assert got["monthly_trend"] == pairs(an.monthly_trend(cases))
    assert got["top_areas"] == pairs(an.top_areas(cases, 10))
    assert got["top_weapons"] == pairs(an.top_weapons(cases, 10))
    assert got["age_groups"] == pairs(an.age_groups(cases))
    assert got["sex_breakdown"] == pairs(an.sex_breakdown(cases))
    assert got["day_of_week"] == pairs(an.day_of_week(cases))
    assert got["hour_of_day"] == [(str(h), c) for h, c in pairs(an.hour_of_day(cases))]
    assert set(reports.metrics_report(cases)) == {"summary", "top_areas", "top_weapons", "recent_in_category"}
