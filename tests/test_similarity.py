import random
from dataclasses import replace

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from brute import pools, vectors
from caselink.functions.text import ENGLISH_STOP_WORDS, text_id
from caselink.operators import similarity as sim
from caselink.operators import tfidf
from caselink.plans import catalog, views
from caselink.sources import text_index
from conftest import SMALL

WORDS = "theft robbery assault vehicle stolen knife gun street central west not".split()


def corpus(seed, n, distinct):
    """Texts with many copies, reordered and repeated words, empty and stop-word-only texts."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(distinct)]
    pool += ["", "the of a", "x y z", None, "Theft ROBBERY", "theft robbery theft robbery", "robbery, theft!"]
    hot = pool[0]
    return [hot if rng.random() < 0.33 else rng.choice(pool) for _ in range(n)]


def as_lists(ranked):
    got = {}
    for r in ranked.select(F.col("base.dr_no").alias("q"), "rank", F.col("cand.dr_no").alias("c"), "similarity").orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["c"], r["similarity"]))
    return got


def test_stop_words_equal_their_source(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens(spark, make_cases):
    cases = make_cases({"dr_no": 1, "mo_text": "The CAFÉ-bar, a 9mm gun_x; it's O K"}, {"dr_no": 2})
    assert [r["term"] for r in tfidf.tokenize(cases, ["dr_no"]).collect()] == ["café", "bar", "9mm", "gun_x"]
    assert [r["term"] for r in tfidf.tokenize(cases, ["dr_no"], ["bar"]).collect()][:3] == ["the", "café", "9mm"]


def test_weights(spark, make_cases):
    texts = corpus(1, 60, 12)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    index = text_index.fit(cases)
    got = {}
    for r in tfidf.per_case(cases, index.texts, index.weights).collect():
        got.setdefault(r["dr_no"], {})[r["term"]] = r["weight"]
    for i, v in enumerate(vectors(texts)):
        assert got.get(i, {}) == pytest.approx(v)


@pytest.mark.parametrize("seed, n, distinct, depth", [(1, 80, 10, 5), (2, 80, 60, 21), (3, 40, 6, 100), (4, 120, 25, 8)])
def test_pools_equal_brute_force(spark, make_cases, tmp_path, seed, n, distinct, depth):
    texts = corpus(seed, n, distinct)
    ids = random.Random(seed).sample(range(1000), n)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in zip(ids, texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    expected = pools(ids, texts, depth)
    wanted = cases.select(text_id("mo_text").alias("q_text"))
    for asked in (None, wanted):
        rows = sim.candidate_pool(index, asked, depth)
        names = {bytes(r["t"]): r["d"] for r in cases.select(text_id("mo_text").alias("t"), F.col("dr_no").alias("d")).collect()}
        got = {}
        for r in rows.select("q_text", "pool_rank", "cand.dr_no", "similarity").orderBy("q_text", "pool_rank").collect():
            got.setdefault(names[bytes(r["q_text"])], []).append((r["dr_no"], r["similarity"]))
        assert len(got) == len(set((t or "") for t in texts))
        for i, pool in got.items():
            assert [c for c, _ in pool] == [c for c, _ in expected[i]]
            assert [s for _, s in pool] == pytest.approx([s for _, s in expected[i]], abs=2e-9)


@pytest.mark.parametrize("k", [3, 19, 60])
def test_lists_leave_out_the_base(spark, make_cases, tmp_path, k):
    texts = corpus(5, 60, 9)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    full = pools(range(60), texts, 60)
    for all_bases in (True, False):
        got = as_lists(sim.similar_cases(index, cases, k, bases_are_all=all_bases))
        assert got.keys() == full.keys()
        for q, hits in got.items():
            assert [c for c, _ in hits] == [c for c, _ in full[q] if c != q][:k]


def test_filters_come_after_the_pool(spark, make_cases, tmp_path, monkeypatch):
    monkeypatch.setattr(sim, "pool_size", lambda k: 10)
    texts = corpus(6, 60, 9)
    cases = make_cases(
        *[
            {"dr_no": i, "mo_text": t, "area_name": "A" if i % 3 == 0 else "B", "weapon_desc": "W" if i % 4 == 0 else None}
            for i, t in enumerate(texts)
        ]
    )
    index = text_index.load_or_fit(cases, str(tmp_path), depth=10)
    pool = pools(range(60), texts, 10)

    def expected(keep):
        lists = {q: [c for c, _ in hits if c != q and keep(c)][:4] for q, hits in pool.items()}
        return {q: hits for q, hits in lists.items() if hits}

    def got(**options):
        return {q: [c for c, _ in hits] for q, hits in as_lists(sim.similar_cases(index, cases, 4, **options)).items()}

    assert got(area="A") == expected(lambda c: c % 3 == 0)
    assert got(weapon="W") == expected(lambda c: c % 4 == 0)
    assert got(area="B", weapon="W") == expected(lambda c: c % 3 and c % 4 == 0)
    assert got(weapon="UNKNOWN") == {}
    assert got(weapon="UNKNOWN", weapon_null_name="UNKNOWN") == expected(lambda c: c % 4)
    assert got(area="All", weapon="") == expected(lambda c: True)
    lists = sim.similar_lists(index, cases, 4, area="none such", how="left")
    assert lists.filter("hits is null").count() == 60


def test_deep_area_lists_of_every_case(spark, make_cases, monkeypatch, tmp_path):
    """The registered query lists all bases, whatever their id."""
    texts = corpus(10, 60, 9)
    areas = [catalog.AREA if i % 3 == 0 else "B" for i in range(60)]
    cases = make_cases(*[{"dr_no": i, "mo_text": t, "area_name": a} for i, (t, a) in enumerate(zip(texts, areas))])
    monkeypatch.setattr(views, "cases", lambda spark, sf_dir: cases)
    monkeypatch.setattr(views, "scratch", lambda spark, sf_dir, name: str(tmp_path / name))
    got = {}
    for r in catalog.QUERIES["similar_by_area_deep"](spark, "").orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["dr_no"])
    full = pools(range(60), texts, 60)
    assert got == {q: [c for c, _ in hits if c != q and c % 3 == 0][: catalog.DEEP_K] for q, hits in full.items()}


def test_deeper_pool_than_the_index(spark, make_cases, tmp_path):
    texts = corpus(7, 50, 5)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    index = text_index.load_or_fit(cases, str(tmp_path), depth=3)
    with pytest.raises(ValueError):
        sim.candidate_pool(replace(index, cases=None), None, 8)
    got = as_lists(sim.similar_cases(index, cases, 7))
    full = pools(range(50), texts, 50)
    assert {q: [c for c, _ in h] for q, h in got.items()} == {q: [c for c, _ in h if c != q][:7] for q, h in full.items()}


def test_unknown_base_and_one_base(spark, make_cases, tmp_path):
    texts = corpus(8, 40, 9)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    assert sim.similar_cases(index, cases.filter("dr_no = 999"), 5).count() == 0
    one = cases.filter("dr_no = 11")
    assert [c for c, _ in as_lists(sim.similar_cases(index, one, 5))[11]] == [c for c, _ in pools(range(40), texts, 40)[11] if c != 11][:5]
    flat = {r["dr_no"]: r["similarity"] for r in sim.cosine_to_all(index, one, cases).collect()}
    assert flat == pytest.approx(dict(pools(range(40), texts, 40)[11]), abs=2e-9)


def test_blocks_do_not_change_the_result(spark, make_cases, tmp_path, monkeypatch):
    texts = corpus(9, 60, 50)
    cases = make_cases(*[{"dr_no": i, "mo_text": t} for i, t in enumerate(texts)])
    index = text_index.load_or_fit(cases, str(tmp_path))
    plain = as_lists(sim.similar_cases(index, cases, 12))
    monkeypatch.setattr(sim, "BLOCK_PAIRS", 7)
    assert as_lists(sim.similar_cases(index, cases, 12)) == plain


def test_whole_documents_against_brute_force(spark, tmp_path):
    docs = views.document_cases(spark, SMALL)
    rows = docs.select("dr_no", "mo_text").collect()
    ids, texts = [r["dr_no"] for r in rows], [r["mo_text"] for r in rows]
    index = text_index.load_or_fit(docs, str(tmp_path))
    full = pools(ids, texts, 21)
    got = as_lists(sim.similar_cases(index, docs, 20))
    assert got.keys() == full.keys()
    for q, hits in got.items():
        others = [h for h in full[q] if h[0] != q][:20]
        assert [s for _, s in hits] == pytest.approx([s for _, s in others], abs=2e-9)
        assert [c for c, _ in hits] == [c for c, _ in others]


def test_index_is_reused_and_renewed(spark, make_cases, tmp_path):
    cases = make_cases({"dr_no": 1, "mo_text": "gun"}, {"dr_no": 2, "mo_text": "knife"})
    path = str(tmp_path)
    first = text_index.load_or_fit(cases, path)
    assert [p.name for p in tmp_path.iterdir()] == [text_index.fingerprint(cases)]
    again = text_index.load_or_fit(cases, path)
    assert again.texts.inputFiles() == first.texts.inputFiles()
    assert again.copies == (1, 1) and again.depth == text_index.DEPTH
    more = cases.unionByName(make_cases({"dr_no": 3, "mo_text": "gun"}))
    assert text_index.load_or_fit(more, path).copies == (1, 2)
    assert len(list(tmp_path.iterdir())) == 2


def test_repeated_rows_have_fingerprints_of_their_own(make_cases):
    a, b = {"dr_no": 1, "mo_text": "a"}, {"dr_no": 1, "mo_text": "b"}
    tables = ([a], [a, a], [b, b], [a, b], [a, a, b, b])
    assert len({text_index.fingerprint(make_cases(*t)) for t in tables}) == len(tables)


def test_plan_limits_groups_before_the_shuffle_and_has_no_python(spark, tmp_path):
    cases = views.cases(spark, SMALL)
    index = text_index.load_or_fit(cases, str(tmp_path))
    plan = sim.similar_cases(index, cases, 20, area="NATION_13")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


def test_a_value_in_a_neighbouring_null_column_is_another_table(make_cases):
    one = make_cases({"dr_no": 1, "crm_cd_desc": "A", "weapon_desc": None})
    other = make_cases({"dr_no": 1, "crm_cd_desc": None, "weapon_desc": "A"})
    assert text_index.fingerprint(one) != text_index.fingerprint(other)
