"""Few asked texts against all texts, terms counted inside a row, weights without a shuffle of all counts."""

import random

import pytest
from pyspark.sql import functions as F

from brute import vectors
from caselink.operators import asked, similarity, tfidf
from caselink.sources import text_index

WORDS = "theft robbery assault vehicle stolen knife gun street central west".split()


def cases_of(make_cases, seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(n)] + [None, "", "the of"]
    return texts, make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_without_an_exchange(spark, make_cases):
    cases = make_cases({"dr_no": 1, "mo_text": "gun the car gun"}, {"dr_no": 2}, {"dr_no": 3, "mo_text": "the"})
    texts = cases.select(F.col("dr_no").alias("text_id"), F.lit(1).alias("n_rows"), "mo_text")
    counts = tfidf.term_counts(texts)
    assert sorted(map(tuple, counts.select("text_id", "term", "tf").collect())) == [(1, "car", 1), (1, "gun", 2)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("common", [500_000, 12, 1])
def test_weights_with_common_and_rare_terms(spark, make_cases, monkeypatch, common):
    monkeypatch.setattr(tfidf, "COMMON", common)
    texts, cases = cases_of(make_cases, 5, 30)
    index = text_index.fit(cases)
    got = {}
    rows = tfidf.per_case(cases, index.texts, index.weights, cases_are_all=True)
    for r in rows.collect():
        assert r["term"] not in got.setdefault(r["dr_no"], {})
        got[r["dr_no"]][r["term"]] = r["weight"]
    for i, v in enumerate(vectors(texts)):
        assert got.get(i, {}) == pytest.approx(v)


@pytest.mark.parametrize("products", [1 << 21, 7])
def test_asked_texts_equal_the_joined_sums(spark, make_cases, tmp_path, monkeypatch, products):
    monkeypatch.setattr(asked, "PRODUCTS", products)
    monkeypatch.setattr(asked, "CELLS", 20)
    _, cases = cases_of(make_cases, 6, 60)
    index = text_index.load_or_fit(cases, str(tmp_path))
    bases = cases.filter("dr_no % 9 = 0 or mo_text is null")
    pool = similarity.similar_cases(index, bases, 5)
    assert "MapInArrow" in plan(pool)
    monkeypatch.setattr(similarity, "asked_weights", lambda *_: None)
    joined = similarity.similar_cases(index, bases, 5)
    assert "MapInArrow" not in plan(joined)
    rows = lambda df: sorted(map(tuple, df.select("base.dr_no", "rank", F.col("cand.dr_no").alias("c"), F.round("similarity", 8)).collect()))
    assert rows(pool) == rows(joined)


def test_too_many_asked_texts_are_left_to_the_join(spark, make_cases, tmp_path, monkeypatch):
    _, cases = cases_of(make_cases, 7, 20)
    index = text_index.load_or_fit(cases, str(tmp_path))
    wanted = index.texts.select(F.col("text_id").alias("q_text"))
    monkeypatch.setattr(asked, "ASKED", 3)
    assert asked.asked_weights(index.lists, wanted) is None


@pytest.mark.parametrize("shared", [500_000, 2])
def test_a_saved_index_equals_a_lazy_one(spark, make_cases, tmp_path, monkeypatch, shared):
    """Texts of one case stay in place; repeated and missing ids, null texts and too many shared texts give the same tables."""
    monkeypatch.setattr(text_index, "SHARED", shared)
    texts = ["gun", "gun", "knife car", None, "", "the of", "car gun", "gun", "only once", "street gun"]
    ids = [5, 3, 3, 7, 7, -1, 8, 3, -1, 1]
    cases = make_cases(*[{"dr_no": i, "mo_text": t, "area_name": str(n)} for n, (i, t) in enumerate(zip(ids, texts))])
    cases = cases.withColumn("dr_no", F.expr("nullif(dr_no, -1)"))
    lazy, saved = text_index.fit(cases, depth=2), text_index.fit(cases, depth=2, path=str(tmp_path))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    sizes = ("text_id", "mo_text", "n_rows", "first_dr")
    assert rows(lazy.texts, *sizes) == rows(saved.texts, *sizes)
    assert rows(lazy.idf, "term", "df", "n_texts", "idf") == rows(saved.idf, "term", "df", "n_texts", "idf")
    weight = F.round("weight", 12)
    assert rows(lazy.weights, "text_id", "term", "tf", "n_texts", weight) == rows(saved.weights, "text_id", "term", "tf", "n_texts", weight)
    assert rows(lazy.leaders, "text_id", "leader_rank", "dr_no") == rows(saved.leaders, "text_id", "leader_rank", "dr_no")


def test_texts_of_one_case_are_not_shuffled(spark, make_cases):
    cases = make_cases(*[{"dr_no": i, "mo_text": f"gun number{i}"} for i in range(20)])
    shared = tfidf.text_sizes(cases).filter("n_rows > 1")
    for df in (tfidf.texts_in_place(cases, shared), text_index.leading_cases(cases, 3, tfidf.text_sizes(cases), shared)):
        alone = df._jdf.queryExecution().optimizedPlan().toString().split("Union")[1]
        assert "LeftAnti" in alone
        assert df.count() == 20
    assert shared.count() == 0


def test_the_most_frequent_terms_are_common(spark, monkeypatch):
    idf = spark.createDataFrame([(str(i), n) for i, n in enumerate([9, 5, 5, 2, 2, 2, 1, 1])], "term string, n_texts long")
    least = {}
    for common in (0, 1, 2, 3, 5, 6, 8):
        monkeypatch.setattr(tfidf, "COMMON", common)
        least[common] = tfidf._least_common(idf)
    assert least == {0: 1 << 62, 1: 9, 2: 9, 3: 5, 5: 5, 6: 2, 8: 1}
