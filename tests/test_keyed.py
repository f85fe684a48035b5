"""Cases with the key of a text in place of the text: nothing moves or stores a text, and pools stay the same."""

import pytest
from pyspark.sql import functions as F

from caselink.functions.text import text_key
from caselink.operators import asked, similarity, tfidf
from caselink.plans import catalog, views
from caselink.sources import text_index
from conftest import SMALL

TEXTS = ["gun", "gun", "knife car", None, "", "the of", "car gun", "gun", "only once", "street gun", "knife knife car street", "gun", ""]
IDS = [5, 3, 3, 7, 7, -1, 8, 3, -1, 1, 12, 5, 13]


@pytest.fixture
def both(make_cases):
    """Cases with texts, the same with keys, and the texts of the keys; ids repeat and miss, a case stands twice."""
    cases = make_cases(*[{"dr_no": i, "mo_text": t, "area_name": "north" if i % 2 else "south"} for i, t in zip(IDS, TEXTS)])
    cases = cases.withColumn("dr_no", F.expr("nullif(dr_no, -1)"))
    spelled = cases.select("dr_no", text_key("mo_text").alias("mo_text"), F.col("mo_text").alias("words"))
    twice = lambda df: df.unionByName(df.filter("dr_no = 12"))
    return twice(cases), twice(cases.withColumn("mo_text", text_key("mo_text"))), spelled


def rows(found):
    return sorted((tuple(r) for r in found.select("base.dr_no", "rank", F.col("cand.dr_no").alias("c"), F.round("similarity", 9), "same").collect()), key=str)


def pools(index, cases):
    found = similarity.similar_cases(index, cases.filter("dr_no in (1, 5, 7, 12, 13)"), 6)
    return rows(found.withColumn("same", F.col("base.mo_text") == F.col("cand.mo_text")))


@pytest.mark.parametrize("shared, common, most", [(500_000, 500_000, 4096), (1, 1, 4096), (500_000, 2, 1)])
def test_a_keyed_index_gives_the_pools_of_the_texts(spark, both, tmp_path, monkeypatch, shared, common, most):
    whole, keyed, spelled = both
    expected = pools(text_index.load_or_fit(whole, str(tmp_path / "a")), whole)
    monkeypatch.setattr(text_index, "SHARED", shared)
    monkeypatch.setattr(tfidf, "COMMON", common)
    monkeypatch.setattr(asked, "ASKED", most)
    for _ in ("fitted", "loaded"):
        index = text_index.load_or_fit_keyed(keyed, spelled, str(tmp_path / "b"))
        assert pools(index, keyed) == expected


def test_lengths_are_those_of_the_weights(spark, both, tmp_path, monkeypatch):
    monkeypatch.setattr(tfidf, "COMMON", 2)
    whole, keyed, spelled = both
    index = text_index.load_or_fit_keyed(keyed, spelled, str(tmp_path))
    lists = tfidf.weight_lists(index.counts, index.idf)
    listed = lambda df: sorted(map(tuple, df.select("text_id", F.round("length", 9)).collect()))
    assert listed(index.lengths) == listed(lists)


def test_document_queries_neither_shuffle_nor_store_texts(spark):
    docs = catalog._keyed_documents(spark, SMALL)
    plain = views.document_cases(spark, SMALL).withColumn("mo_text", text_key("mo_text"))
    assert docs.exceptAll(plain).isEmpty() and plain.exceptAll(docs).isEmpty()
    joined = views.document_cases(spark, SMALL, keyed=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in joined.split("Join")[-1]
    index = catalog._document_index(spark, SMALL, docs)
    assert index.weights is None
    for stored in (docs, index.texts, index.leaders):
        assert stored.agg(F.max(F.length("mo_text"))).first()[0] == 32
