from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselink.operators import prepare
from caselink.schema import CASE_COLUMNS
from caselink.sources import cases as case_io


def test_headers():
    names = [" DR_NO ", "DATE OCC", "Crm Cd Desc", "Rpt. Dist"]
    assert [case_io.normalize_header(n) for n in names] == ["dr_no", "date_occ", "crm_cd_desc", "rpt_dist"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("03/05/2024 01:30:00 PM", datetime(2024, 3, 5, 13, 30)),
        ("2024-03-05 13:30:00", datetime(2024, 3, 5, 13, 30)),
        ("2024-03-05", datetime(2024, 3, 5)),
        ("03/05/2024", datetime(2024, 3, 5)),
        ("2020-03-01T00:00:00.000", datetime(2020, 3, 1)),
        ("2020-03-01 10:00:00.123", datetime(2020, 3, 1, 10, 0, 0, 123000)),
        ("2020-03-01T10:00:00.123456", datetime(2020, 3, 1, 10, 0, 0, 123456)),
        ("1/5/2024", datetime(2024, 1, 5)),
        ("1/5/2024 7:05", datetime(2024, 1, 5, 7, 5)),
        ("01/05/2024 9:30:00 AM", datetime(2024, 1, 5, 9, 30)),
        ("2024/01/05", datetime(2024, 1, 5)),
        ("13/45/2024", None),
        ("", None),
        (None, None),
        ("soon", None),
    ],
)
def test_dates(spark, text, expected):
    row = spark.createDataFrame([(text,)], "d string").select(prepare.lenient_timestamp(F.col("d")).alias("t")).first()
    assert row["t"] == expected


def test_dates_are_cut_to_days_and_bad_rows_dropped(spark):
    df = spark.createDataFrame([("1", "03/05/2024 01:30:00 PM"), ("2", "x")], "dr_no string, date_occ string")
    assert [r["datetime"] for r in prepare.parse_dates(df).collect()] == [datetime(2024, 3, 5)]
    assert [r["datetime"] for r in prepare.parse_dates(df, keep_time=True).collect()] == [datetime(2024, 3, 5, 13, 30)]


def test_mo_text(spark):
    df = spark.createDataFrame(
        [("THEFT", None, "Central"), ("ARSON", "nan", None)], "crm_cd_desc string, weapon_desc string, area_name string"
    )
    texts = lambda d, **o: [r["mo_text"] for r in prepare.build_mo_text(d, **o).collect()]
    assert texts(df) == ["theft nan central", "arson nan nan"]
    assert texts(df, null_token="") == ["theft  central", "arson nan "]
    assert texts(df.drop("weapon_desc")) == ["theft theft central", "arson arson nan"]


def test_sentinel_is_replaced_as_whole_cell_only(spark):
    df = spark.createDataFrame([("nan", "theft nan central", 1)], "a string, b string, c int")
    assert prepare.replace_sentinel(df).first() == ("unknown", "theft nan central", 1)


def test_clean_keeps_present_columns_in_order(spark):
    df = spark.createDataFrame([("x", "1", "a")], "extra string, dr_no string, area_name string")
    assert prepare.clean_cases(df).columns == ["dr_no", "area_name"]


def test_recent_cases(spark, make_cases):
    days = [5, 3, 3, 3, 9, 1, 9, 3]
    cases = make_cases(*[{"dr_no": i, "datetime": datetime(2024, 1, d)} for i, d in enumerate(days)], {"dr_no": 99})
    order = sorted(range(len(days)), key=lambda i: (-days[i], i)) + [99]
    for n in range(1, len(order) + 2):
        assert sorted(r["dr_no"] for r in prepare.recent_cases(cases, n).collect()) == sorted(order[:n]), n
    assert prepare.recent_cases(cases, None).count() == 9
    assert prepare.recent_cases(cases.limit(0), 3).count() == 0


def test_recent_cases_within_one_time(spark):
    """A day that holds most rows is cut by time first and id second."""
    rows = spark.range(500).select(
        F.col("id").alias("dr_no"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 5).cast("int"))).alias("datetime"),
    )
    expected = [r["dr_no"] for r in rows.orderBy(F.desc("datetime"), "dr_no").limit(130).collect()]
    assert sorted(r["dr_no"] for r in prepare.recent_cases(rows, 130).collect()) == sorted(expected)


def test_recent_cases_by_ranges_of_ids(spark, make_cases, monkeypatch):
    monkeypatch.setattr(prepare, "ORDERED_ROWS", 3)
    ids = [i * i * 7919 % 100_003 for i in range(200)]
    cases = make_cases(*[{"dr_no": i, "datetime": datetime(2024, 1, 1)} for i in ids])
    for n in (1, 2, 50, 199, 200):
        assert sorted(r["dr_no"] for r in prepare.recent_cases(cases, n).collect()) == sorted(ids)[:n]


def test_one_row_per_id(spark, make_cases):
    rows = [
        {"dr_no": 1, "datetime": datetime(2024, 1, 1), "area_name": "B"},
        {"dr_no": 1, "datetime": datetime(2024, 1, 2), "area_name": "A"},
        {"dr_no": 1, "datetime": datetime(2024, 1, 2), "area_name": None},
        {"dr_no": 2}, {"dr_no": 2}, {"dr_no": 2, "vict_age": 5},
    ]
    got = {r["dr_no"]: r for r in prepare.deduplicated_cases(make_cases(*rows)).collect()}
    assert len(got) == 2 and got[1]["area_name"] == "A" and got[2]["vict_age"] == 5


def test_dropped_rows_are_counted(spark):
    rows = [("1", "2024-01-05"), ("1", "2024-01-05"), ("1", "soon"), ("2", None), ("3", " "), ("4", "never"), ("5", "1/5/2024")]
    raw = spark.createDataFrame(rows, "dr_no string, date_occ string")
    got = {r["reason"]: r["rows"] for r in prepare.dropped_rows(raw).collect()}
    assert got == {prepare.REPEATED_ID: 1, prepare.UNREADABLE_DATE: 2, prepare.NO_DATE: 2}


def test_rows_without_an_id_stay(spark):
    rows = [("1", "1/5/2024"), ("01", "1/6/2024"), (None, "1/6/2024"), (None, "1/6/2024"), ("12A", "1/6/2024"), (" ", "1/4/2024"), ("x", "soon")]
    raw = spark.createDataFrame([(*r, "A", "B") for r in rows], "dr_no string, date_occ string, area_name string, crm_cd_desc string")
    cases = prepare.prepare_cases(raw)
    assert sorted((r["dr_no"] or 0, r["datetime"].day) for r in cases.collect()) == [(0, 4), (0, 6), (0, 6), (0, 6), (1, 6)]
    got = {r["reason"]: r["rows"] for r in prepare.dropped_rows(raw).collect()}
    assert got == {prepare.REPEATED_ID: 1, prepare.UNREADABLE_DATE: 1}
    assert raw.count() == cases.count() + sum(got.values())
    # Within one time the rows without an id are the last, and go together.
    for n, kept in ((1, [1]), (2, [0, 0, 0, 1]), (4, [0, 0, 0, 1]), (5, [0, 0, 0, 0, 1]), (9, [0, 0, 0, 0, 1])):
        assert sorted(r["dr_no"] or 0 for r in prepare.prepare_cases(raw, n).collect()) == kept, n


def test_whole_numbers_with_a_decimal(spark):
    raw = spark.createDataFrame([("1", "34.0", "510"), ("2", "34.5", "x"), ("3", None, "1e2")], "dr_no string, vict_age string, crm_cd string")
    got = [(r["vict_age"], r["crm_cd"]) for r in case_io.with_case_types(raw).orderBy("dr_no").collect()]
    assert got == [(34, 510), (None, None), (None, 100)]


def test_files(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(
        'DR_NO,DATE OCC,AREA NAME,Crm Cd,Crm Cd Desc,Weapon Desc,Vict Age,Vict Sex,LAT.\n'
        '7,01/02/2024 12:00:00 AM,"Central, ""Old""",310,BURGLARY,,x,F,1.5\n'
        '8,never,Central,310,BURGLARY,,30,F,1.5\n'
        '9,01/03/2024 12:00:00 AM,Wilshire,510,VEHICLE - STOLEN,nan,41,,1.5\n'
    )
    for kind in ("parquet", "csv"):
        out = str(tmp_path / kind)
        prepare.preprocess_cases(spark, str(raw), out, output_format=kind)
        back = case_io.read_cases(spark, out, kind)
        assert back.columns == CASE_COLUMNS
        rows = {r["dr_no"]: r for r in back.collect()}
        assert set(rows) == {7, 9}
        assert rows[7]["area_name"] == 'Central, "Old"'
        assert rows[7]["vict_age"] is None and rows[7]["weapon_desc"] is None
        assert rows[7]["mo_text"] == 'burglary nan central, "old"'
        assert rows[9]["weapon_desc"] == "unknown" and rows[9]["mo_text"] == "vehicle - stolen nan wilshire"
        assert rows[9]["datetime"] == datetime(2024, 1, 3) and rows[9]["crm_cd"] == 510
