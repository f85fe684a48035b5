"""Rankings of all cases: bases dealt by id, the lists of few texts sent to them."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.operators import similarity
from caselink.sources import text_index


def test_dealt_cases_equal_similar_cases_and_shuffle_no_pair(spark, make_cases, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = ["gun car", "gun", "knife car", "knife", None, "", "the of"]
    rows = [{"dr_no": i % 50, "mo_text": rng.choice(texts), "area_name": str(i)} for i in range(60)]
    cases = make_cases(*rows).withColumn("dr_no", F.expr("nullif(dr_no, 7)"))
    index = text_index.load_or_fit(cases, str(tmp_path))
    dealt = similarity.dealt_cases(index, cases, 4, 10)
    listed = similarity.similar_cases(index, cases, 4, bases_are_all=True)
    # Rows of one id and text are as good as one another, so only ids are compared.
    ids = lambda df: sorted(map(tuple, df.select("base.dr_no", "base.area_name", "rank", F.col("cand.dr_no").alias("c"), F.round("similarity", 8)).collect()), key=str)
    assert ids(dealt) == ids(listed)
    ranked = dealt.withColumn("place", F.row_number().over(W.partitionBy("q_id").orderBy("rank", "cand.dr_no")))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(ranked) == exchanges(dealt)
    monkeypatch.setattr(similarity, "LISTED", 1000)
    assert similarity.dealt_cases(index, cases, 4, 10) is None


def test_few_pools_take_wide_cases_after_the_draw(spark, make_cases, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = ["gun car", "gun", "knife car", "knife street", None, "", "the of", "west"]
    rows = [{"dr_no": i % 45, "mo_text": rng.choice(texts), "area_name": f"a{i % 45}"} for i in range(60)]
    cases = make_cases(*rows).withColumn("dr_no", F.expr("nullif(dr_no, 7)"))
    index = text_index.load_or_fit(cases, str(tmp_path))
    bases = cases.filter("dr_no % 5 = 1 or mo_text is null")
    rows = lambda df: sorted(map(tuple, df.select("base.dr_no", "base.area_name", "rank", F.col("cand.dr_no").alias("c"), F.round("similarity", 8)).collect()), key=str)
    few = similarity.similar_cases(index, bases, 6)
    # The exchanges by text before the lists are grouped carry ids alone; only the grouping carries cases.
    wide = [x for x in few._jdf.queryExecution().optimizedPlan().toString().splitlines() if "WindowGroupLimit" in x or "Window [" in x]
    assert wide and not any("area_name" in x for x in wide)
    got = rows(few)
    monkeypatch.setattr(similarity, "SENT", 0)
    assert got == rows(similarity.similar_cases(index, bases, 6))
    assert len(got) > 50
