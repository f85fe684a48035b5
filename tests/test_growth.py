"""Indexes that grow or are looked up, malformed lines, relevant counts, held-out samples."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from caselink.operators import analytics, evaluation, id_search, linkage
from caselink.sources import cases as case_io
from caselink.sources import growing_index, text_index


def table(df, *keys):
    return sorted(map(tuple, df.select(*keys).collect()), key=str)


def test_appended_parts_equal_a_fresh_fit(spark, make_cases, tmp_path):
    random.seed(1)
    texts = [None, "", "gun in car", "knife", "gun in car", "the car the car", "window broken car"]
    rows = [{"dr_no": i, "mo_text": random.choice(texts), "area_name": str(i % 3)} for i in range(60)]
    rows[-1]["mo_text"] = "only in the last part"
    parts = [rows[:10], rows[10:45], rows[45:]]
    path = str(tmp_path)
    assert growing_index.load(spark, path) is None
    for i, part in enumerate(parts):
        growing_index.append(make_cases(*part), path, f"v{i}", depth=4)
        growing_index.append(make_cases(*part), path, f"v{i}", depth=4)
        so_far = make_cases(*itertools.chain(*parts[: i + 1]))
        fresh, grown = text_index.fit(so_far, depth=4), growing_index.load(spark, path, depth=4)
        assert growing_index.versions(spark, path) == [f"v{j}" for j in range(i + 1)]
        assert table(grown.texts, "text_id", "mo_text", "n_rows", "first_dr") == table(fresh.texts, "text_id", "mo_text", "n_rows", "first_dr")
        rounded = lambda d, c: d.withColumn(c, F.round(c, 12))
        assert table(rounded(grown.idf, "idf"), "term", "df", "n_texts", "idf") == table(rounded(fresh.idf, "idf"), "term", "df", "n_texts", "idf")
        keys = ("text_id", "n_rows", "term", "tf", "n_texts", "weight")
        assert table(rounded(grown.weights, "weight"), *keys) == table(rounded(fresh.weights, "weight"), *keys)
        assert table(grown.leaders, "text_id", "leader_rank", "dr_no") == table(fresh.leaders, "text_id", "leader_rank", "dr_no")


def test_a_part_that_was_cut_short_is_not_seen(spark, make_cases, tmp_path):
    path = str(tmp_path)
    growing_index.append(make_cases({"dr_no": 1, "mo_text": "gun"}), path, "a")
    make_cases({"dr_no": 2, "mo_text": "x y z"}).write.parquet(f"{path}/parts/b/texts")
    assert growing_index.load(spark, path).texts.count() == 1
    growing_index.append(make_cases({"dr_no": 3, "mo_text": "gun"}), path, "b")
    assert growing_index.load(spark, path).texts.first()["n_rows"] == 2


@pytest.mark.parametrize(
    "pattern, runs",
    [("123", ["123"]), ("1.34", ["34"]), ("^12.*56$", ["12", "56"]), ("12?34", ["34"]), ("123+4", ["123"]), ("12{2}34", ["34"]), (r"\d12", ["12"]), ("[12]34", ["34"]), ("1|23", []), ("(12)3", []), (r"1\.2", []), ("", [])],
)
def test_literals_of_patterns(pattern, runs):
    assert id_search.literals(pattern) == runs


def test_ids_by_grams_equal_a_full_scan(spark, make_cases, tmp_path):
    random.seed(2)
    ids = [random.randrange(10 ** random.randint(1, 7)) for _ in range(400)]
    cases = make_cases(*[{"dr_no": i} for i in [*ids, ids[0], -123]])
    grams = id_search.write_id_grams(cases, str(tmp_path))
    for pattern in ("12", "123", "1.3", "^9", "00", "^1.*23", "45+6?", "(1|2)34", "77$", "", "-12"):
        found = table(id_search.search_ids_by_grams(grams, cases.distinct(), pattern, 500), "dr_no")
        assert found == table(analytics.search_case_ids(cases.distinct(), pattern, 500), "dr_no"), pattern
    plan = id_search.search_ids_by_grams(grams, cases, "1234")._jdf.queryExecution().executedPlan().toString()
    # Both runs are read by their gram, the cases not at all.
    assert plan.count("EqualTo(gram,") == 2 and plan.count("FileScan") == 2 and "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_lines_are_rows_or_rejected(spark, tmp_path):
    lines = [
        "A,B.,C", "1,2,3", '"x, y",2,"say ""hi"""', "", "  ", "1,2", "1,2,3,4", '"1,2,3', '1,"begins', 'ends",3', ",,", '"","a,b",', "A,B.,C",
    ]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines) + "\n")
    rows, rejected = case_io.read_checked_cases(spark, str(path), ["A", "B.", "C"])
    assert rows.columns == ["a", "b", "c"]
    assert table(rows, "a", "b", "c") == sorted([("1", "2", "3"), ("x, y", "2", 'say "hi"'), (None, None, None), (None, "a,b", None)], key=str)
    reasons = {r["line"]: r["reason"] for r in rejected.collect()}
    assert reasons == {
        "": "blank line", "  ": "blank line", "1,2": "too few fields", "1,2,3,4": "too many fields", '"1,2,3': "open quote", '1,"begins': "open quote", 'ends",3': "open quote",
    }
    assert rows.count() + rejected.count() == len(lines) - 2


def test_relevant_counts_equal_pairing(make_cases):
    random.seed(3)
    pick = lambda *xs: random.choice(xs)
    rows = [{"dr_no": i, "crm_cd": pick(1, 2, None), "area_name": pick("a", "b", None, ""), "weapon_desc": pick("w", None), "mo_text": pick("s", "t", "", None)} for i in range(150)]
    cases = make_cases(*rows)
    fields = evaluation.RULE_FIELDS
    agree = lambda x, y: sum(x[f] is not None and x[f] == y[f] for f in fields)
    expected = {x["dr_no"]: sum(agree(x, y) >= 2 for y in rows if y is not x) for x in rows}
    assert {r["dr_no"]: r["relevant"] for r in evaluation.with_relevant_count(cases, cases).collect()} == expected


def test_no_text_is_on_both_sides(spark, make_cases, tmp_path):
    rows = [{"dr_no": i, "mo_text": f"text number{i % 40} words", "crm_cd": i % 2, "area_name": "A", "datetime": None} for i in range(200)]
    cases = make_cases(*rows)
    side = {r["mo_text"]: r["held"] for r in cases.select("mo_text", linkage.held_out().alias("held")).collect()}
    assert 0 < sum(side.values()) < 20
    index = text_index.load_or_fit(cases, str(tmp_path))
    pairs = linkage.training_pairs(index, cases, n=30, k=5, apart=True).select("base.mo_text", F.col("cand.mo_text").alias("c"), "rank").collect()
    assert pairs and not any(side[r["mo_text"]] or side[r["c"]] for r in pairs)
    assert max(r["rank"] for r in pairs) == 5
