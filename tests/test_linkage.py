import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselink.functions import metrics as m
from caselink.functions.pairs import is_relevant, pair_features
from caselink.operators import ensemble, evaluation, linkage
from caselink.operators.similarity import similar_cases
from caselink.plans import evaluation_run, views
from caselink.schema import CASE_COLUMNS, FEATURES
from caselink.sources import models, text_index
from conftest import SMALL


def pair_up(make_cases, base, *cands):
    """Rows with one base and each candidate, in order."""
    rows = make_cases({"dr_no": 0, **base}).select(F.struct(*CASE_COLUMNS).alias("base"))
    others = make_cases(*[{"dr_no": i + 1, **c} for i, c in enumerate(cands)]).select(F.struct(*CASE_COLUMNS).alias("cand"))
    return rows.join(others, F.lit(True)).orderBy("cand.dr_no")


def features_of(df):
    columns = pair_features(F.lit(None).cast("double"), F.col("base"), F.col("cand"))
    return [r.asDict() for r in df.select(*[columns[f].alias(f) for f in FEATURES]).collect()]


def test_nulls_never_match(make_cases):
    full = {"area_name": "A", "weapon_desc": "W", "crm_cd": 1, "vict_sex": "F", "datetime": datetime(2024, 1, 2)}
    empty = {"datetime": datetime(2024, 1, 2)}
    for base, cand, expected in ((full, full, 1), (full, empty, 0), (empty, full, 0), (empty, empty, 0)):
        row = features_of(pair_up(make_cases, base, cand))[0]
        assert row["similarity"] == 0.0
        assert [row[f] for f in ("area_match", "weapon_match", "crime_code_match", "sex_match")] == [expected] * 4


def test_ages_default_to_forty(make_cases):
    day = {"datetime": datetime(2024, 1, 1)}
    ages = lambda base, *cands: [
        r["age_difference"]
        for r in features_of(pair_up(make_cases, {"vict_age": base, **day}, *[{"vict_age": a, **day} for a in cands]))
    ]
    assert ages(30, 25, None, 41) == [5.0, 10.0, 11.0]
    assert ages(None, 25, None) == [15.0, 0.0]


def test_days_are_rounded_down_before_the_sign_goes(make_cases):
    at = lambda *a: {"datetime": datetime(*a)}
    rows = pair_up(make_cases, at(2024, 1, 2), at(2024, 1, 1), at(2024, 1, 2, 12), at(2024, 1, 1, 23), at(2024, 2, 2, 5))
    assert [r["time_decay"] for r in features_of(rows)] == pytest.approx([math.exp(-d / 365) for d in (1, 0, 1, 31)])


def test_relevance_needs_two_agreements(make_cases):
    base = {"crm_cd": 1, "area_name": "A", "weapon_desc": None, "mo_text": "t"}
    cands = [
        {"crm_cd": 1, "area_name": "A"},
        {"crm_cd": 1, "area_name": "B"},
        {"area_name": "A", "mo_text": "t"},
        {"mo_text": "t"},
        {},
        {"crm_cd": 1, "weapon_desc": None},
    ]
    rows = pair_up(make_cases, base, *cands).select(is_relevant(F.col("base"), F.col("cand")).alias("y")).collect()
    assert [r["y"] for r in rows] == [1, 0, 1, 0, 0, 0]


def test_sample_is_the_same_for_any_split(spark, make_cases):
    cases = make_cases(*[{"dr_no": i, "crm_cd": 1 if i % 5 else None, "area_name": "A", "mo_text": "t"} for i in range(300)])
    picked = lambda df, n, **o: sorted(r["dr_no"] for r in linkage.sample_cases(df, n, **o).collect())
    first = picked(cases, 40)
    assert len(first) == 40 and all(i % 5 for i in first)
    assert picked(cases.repartition(17), 40) == first
    assert picked(cases, 40, seed=7) != first
    assert len(picked(cases, 1000)) == 240


def metric_row(spark, rels, k, same_crime=10):
    df = spark.createDataFrame([(rels, k, same_crime)], "rels array<int>, k int, n long")
    p, r = m.precision(F.col("rels"), F.col("k")), m.recall(F.col("rels"), F.col("n"))
    return df.select(
        p.alias("p"), r.alias("r"), m.f1(p, r).alias("f1"), m.ndcg(F.col("rels"), 20).alias("ndcg"),
        m.average_precision(F.col("rels")).alias("ap"),
    ).first()


def test_metrics_worked_by_hand(spark):
    row = metric_row(spark, [1, 0, 1, 1, 0], 5)
    assert row["p"] == pytest.approx(0.6)
    assert row["r"] == pytest.approx(3 / max(0.3 * 10, 3))
    assert row["f1"] == pytest.approx(2 * 0.6 / 1.6)
    dcg = 1 + 1 / math.log2(4) + 1 / math.log2(5)
    assert row["ndcg"] == pytest.approx(dcg / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    assert row["ap"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    short = metric_row(spark, [1, 1], 5, 100)
    assert (short["p"], short["ndcg"]) == pytest.approx((0.4, 1.0)) and short["r"] == pytest.approx(2 / 30)
    assert tuple(metric_row(spark, [], 5)) == (0, 0, 0, 0, 0)
    assert tuple(metric_row(spark, [0, 0], 2, 0)) == (0, 0, 0, 0, 0)
    assert metric_row(spark, [1], 1, 0)["r"] == 1.0


def test_a_base_without_candidates_counts_as_zero(spark, make_cases, tmp_path):
    cases = make_cases({"dr_no": 1, "mo_text": "gun", "crm_cd": 1, "area_name": "A"})
    index = text_index.load_or_fit(cases, str(tmp_path))
    rows = evaluation.similarity_metrics(index, cases, cases, [1, 3]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0, 0, 0, 0), (1, 3, 0, 0, 0, 0)]
    assert evaluation.mean_average_precision(evaluation.average_precisions(index, cases, 3)).first()["map"] == 0.0


def test_training_needs_both_labels(spark, make_cases):
    rows = [(*([0.5] * len(FEATURES)), 1) for _ in range(20)]
    pairs = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label int")
    with pytest.raises(ValueError, match="label 0"):
        ensemble.train(pairs, trees=2)


@pytest.fixture(scope="module")
def learnt(spark, tmp_path_factory):
    """Index, cases and a small ensemble on the document cases."""
    folder = str(tmp_path_factory.mktemp("learnt"))
    docs = views.document_cases(spark, SMALL)
    index = text_index.load_or_fit(docs, f"{folder}/index")
    run = evaluation_run.run_evaluation(index, docs, f"{folder}/run", n=60, eval_cases=10, k_values=(1, 3), trees=5)
    return index, docs, run, evaluation_run.model_folder(docs, f"{folder}/run", 60, 5)


def test_run_evaluation(spark, learnt):
    _, _, run, _ = learnt
    rate = run.label_rate.first()
    assert 0 < rate["positives"] < rate["pairs"] <= 60 * 15
    importances = run.importances.collect()
    assert sorted(r["feature"] for r in importances) == sorted(FEATURES)
    for column in ("rf", "gb", "avg"):
        assert sum(r[column] for r in importances) == pytest.approx(1)
    assert [r["avg"] for r in importances] == sorted((r["avg"] for r in importances), reverse=True)
    table = run.comparison.collect()
    assert [r["k"] for r in table] == [1, 3]
    assert all(0 <= v <= 1 for r in table for v in r[1:])


def test_ranking_and_reload(spark, learnt):
    index, docs, run, folder = learnt
    candidates = similar_cases(index, docs, ensemble.served_pool(10))
    served = ensemble.as_served(ensemble.rank_cases(candidates, run.model, 10))
    rows = served.orderBy("q_id", "rank").collect()
    lists = {}
    for r in rows:
        lists.setdefault(r["q_id"], []).append(r)
    assert len(lists) == docs.count()
    for q, hits in lists.items():
        assert [h["rank"] for h in hits] == list(range(1, 11))
        assert q not in [h["dr_no"] for h in hits]
        keys = [(-round(h["score"], 9), -h["similarity"], h["dr_no"]) for h in hits]
        assert keys == sorted(keys) and all(0 <= h["score"] <= 1 for h in hits)
    assert rows[0]["features"].asDict().keys() == set(FEATURES) - {"similarity"}
    again = models.load_or_train(spark, f"{folder}/model", lambda: pytest.fail("the saved model was not used"))
    assert again.features == tuple(FEATURES)
    key = ["q_id", "dr_no", "score"]
    reloaded = ensemble.as_served(ensemble.rank_cases(candidates, again, 10)).select(*key)
    assert sorted(map(tuple, reloaded.collect())) == sorted(tuple(r[c] for c in key) for r in rows)


def test_model_folder_follows_cases_and_settings(learnt):
    docs = learnt[1]
    folders = [evaluation_run.model_folder(docs, "f", n, trees) for n, trees in ((60, 5), (61, 5), (60, 6))]
    folders.append(evaluation_run.model_folder(docs.filter("dr_no > 3"), "f", 60, 5))
    folders.append(evaluation_run.model_folder(docs, "f", 60, 5, apart=True))
    folders += [evaluation_run.model_folder(docs, "f", 60, 5, version=v) for v in ("1", "2")]
    assert len(set(folders)) == 7 and folders[0] == evaluation_run.model_folder(docs, "f", 60, 5)


def test_model_without_its_marker_is_trained_again(spark, learnt, tmp_path):
    (tmp_path / "model" / "forest").mkdir(parents=True)
    model = models.load_or_train(spark, str(tmp_path / "model"), lambda: learnt[2].model)
    assert model is learnt[2].model
    assert models.load(spark, str(tmp_path / "model")).features == model.features


def test_a_fault_in_a_saved_model_is_no_reason_to_train(spark, learnt, tmp_path):
    (tmp_path / "features").mkdir()
    (tmp_path / "features" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        models.load_or_train(spark, str(tmp_path), lambda: pytest.fail("trained"))


def test_features_can_be_left_out(spark, learnt):
    pairs = spark.read.parquet(f"{learnt[3]}/pairs")
    kept = [f for f in FEATURES if f not in ("sex_match", "age_difference")]
    model = ensemble.train(pairs, kept, trees=2)
    assert ensemble.importances(model, spark).count() == 5
    assert {"p_rf", "p_gb", "score"} <= set(ensemble.score(pairs, model).columns)


def test_evaluation_apart_from_training(spark, learnt, tmp_path):
    index, docs, _, _ = learnt
    run = evaluation_run.run_evaluation(index, docs, str(tmp_path), n=60, eval_cases=10, k_values=(1, 3), trees=3, apart=True, version="1")
    pairs = spark.read.parquet(evaluation_run.model_folder(docs, str(tmp_path), 60, 3, apart=True, version="1") + "/pairs")
    held = lambda c: F.count(F.when(linkage.held_out(F.col(f"{c}.mo_text")), 1))
    assert tuple(pairs.agg(held("base"), held("cand")).first()) == (0, 0) and run.label_rate.first()["pairs"] == pairs.count()
    rows = run.comparison.collect()
    assert [r["k"] for r in rows] == [1, 3] and all(0 <= r[c] <= 1 for r in rows for c in run.comparison.columns[1:])
