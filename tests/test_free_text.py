"""Exact nearest texts with pruning, and lists within a part of the cases."""

import random

import pytest
from pyspark.sql import functions as F

from brute import pools
from caselink.operators import blocks, pruned, similarity
from caselink.sources import text_index


def texts_of(seed, n, topics=12, words=40):
    """Texts of topics with words of their own and some that all share, of mixed lengths, some repeated."""
    random.seed(seed)
    shared = [f"common{i}" for i in range(6)]
    vocabulary = [[f"t{t}w{i}" for i in range(words)] for t in range(topics)]
    out = ["", "common0", "common0 common1", "of the and", "solo"]
    while len(out) < n:
        topic = vocabulary[random.randrange(topics)]
        body = random.choices(topic, k=random.choice([1, 2, 5, 20, 60])) + random.choices(shared, k=random.choice([0, 1, 4, 10]))
        out += [" ".join(body)] * random.choice([1, 1, 1, 2, 4])
    return out[:n]


def as_lists(df):
    found = {}
    for r in df.select("base.dr_no", "rank", F.col("cand.dr_no").alias("c"), "similarity").collect():
        found.setdefault(r["dr_no"], []).append((r["rank"], r["c"], r["similarity"]))
    return {q: [(c, s) for _, c, s in sorted(hits)] for q, hits in found.items()}


@pytest.mark.parametrize("k", [1, 5, 20])
def test_pruned_lists_equal_brute_force(make_cases, tmp_path, k):
    texts = texts_of(k, 120)
    ids = list(range(1, len(texts) + 1))
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in zip(ids, texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    got = as_lists(similarity.similar_cases(index, cases, k, bases_are_all=True, pruned=True))
    full = pools(ids, texts, k + 1)
    for q in ids:
        others = [h for h in full[q] if h[0] != q][:k]
        assert [c for c, _ in got[q]] == [c for c, _ in others]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in others], abs=2e-9)


def test_pruned_lists_of_some_bases(make_cases, tmp_path):
    texts = texts_of(9, 90)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    bases = cases.filter("dr_no < 10")
    plain, cut = (as_lists(similarity.similar_cases(index, bases, 7, pruned=p)) for p in (False, True))
    assert plain == cut


@pytest.mark.parametrize("size, entries", [(1024, 1 << 19), (7, 30)])
def test_blocks_find_what_shuffled_pairs_find(spark, make_cases, tmp_path, monkeypatch, size, entries):
    texts = texts_of(11, 110)
    ids = [i * 37 % 110 for i in range(len(texts))]
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in zip(ids, texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    listed = lambda wanted, k: sorted(map(tuple, similarity.candidate_pool(index, wanted, k, pruned=True).select("q_text", "pool_rank", "cand.dr_no", "similarity").collect()), key=str)
    some = index.texts.filter("n_rows > 1").select(F.col("text_id").alias("q_text"))
    pairs = [listed(wanted, k) for wanted, k in ((None, 6), (some, 150))]
    monkeypatch.setattr(pruned, "ROWS", 0)
    monkeypatch.setattr(blocks, "TEXTS", size)
    monkeypatch.setattr(blocks, "ENTRIES", entries)
    assert [listed(wanted, k) for wanted, k in ((None, 6), (some, 150))] == pairs


def test_blocks_shuffle_no_pair(make_cases, tmp_path, monkeypatch):
    """Texts that all share a term: the pairs met go with the square, what the blocks give does not."""
    cases = make_cases(*[{"dr_no": i, "mo_text": f"common word{i} other{i % 7}"} for i in range(200)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    assert pruned.shuffled_rows(index.weights, 4) > 200 * 200
    monkeypatch.setattr(pruned, "ROWS", 1000)
    monkeypatch.setattr(blocks, "TEXTS", 16)
    found = pruned.nearest_matches(index.weights, None, 4, index.lists)
    assert found.groupBy("q_text").count().agg(F.max("count")).first()[0] <= 4 * 8
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_pruning_meets_few_of_the_pairs(make_cases, tmp_path):
    texts = texts_of(3, 400, topics=20)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    weights = text_index.load_or_fit(cases, str(tmp_path)).weights
    postings = pruned.with_remainders(weights)
    met = pruned.candidate_terms(postings, pruned.floors(postings, weights, None, 6)).count()
    summed = weights.groupBy("term").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert met < summed / 3, (met, summed)


def test_lists_within_an_area_are_whole(make_cases, tmp_path):
    random.seed(4)
    texts = texts_of(5, 100, topics=5)
    rows = [{"dr_no": i, "mo_text": t, "area_name": random.choice(["A", "A", "B", None]), "weapon_desc": random.choice(["W", None])} for i, t in enumerate(texts)]
    cases = make_cases(*rows)
    index = text_index.load_or_fit(cases, str(tmp_path / "index"))
    every = pools(list(range(len(texts))), texts, len(texts))
    for field, value in (("area_name", "B"), ("area_name", None), ("weapon_desc", "W"), ("area_name", "none")):
        inside = {r["dr_no"] for r in rows if r[field] == value}
        got = as_lists(similarity.similar_within(index, cases, 15, field, value, str(tmp_path / "by"), bases_are_all=True))
        for q in range(len(texts)):
            expected = [h for h in every[q] if h[0] in inside and h[0] != q][:15]
            assert [c for c, _ in got.get(q, [])] == [c for c, _ in expected]


def test_lists_within_deeper_than_the_index(make_cases, tmp_path):
    rows = [{"dr_no": i, "mo_text": "same words", "area_name": "A" if i % 2 else "B"} for i in range(30)]
    cases = make_cases(*rows)
    index = text_index.load_or_fit(cases, str(tmp_path), depth=3)
    got = as_lists(similarity.similar_within(index, cases.filter("dr_no = 0"), 10, "area_name", "A"))
    assert [c for c, _ in got[0]] == list(range(1, 20, 2))
