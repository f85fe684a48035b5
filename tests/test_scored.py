"""Scores of many pairs: the trees see one row of each cell between their bounds, and every pair finds the same score."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselink.operators import ensemble, similarity
from caselink.plans import catalog
from caselink.schema import CASE_COLUMNS, FEATURES
from caselink.sources import text_index
from conftest import SMALL

SCHEMA = ", ".join(f"{f} {'int' if f.endswith('match') else 'double'}" for f in FEATURES)


def rows_of(rng, n):
    yes = lambda: rng.randint(0, 1)
    for _ in range(n):
        yield round(rng.random(), 2), yes(), yes(), yes(), math.exp(-rng.randint(0, 900) / 365), yes(), float(rng.randint(0, 40))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(11)
    rows = [(*r, int(r[0] + r[1] / 2 + r[4] / 3 + rng.random() / 4 > 1)) for r in rows_of(rng, 400)]
    return ensemble.train(spark.createDataFrame(rows, SCHEMA + ", label int"), trees=6)


def scores(df):
    return sorted(map(tuple, df.select("id", "p_rf", "p_gb", "score").collect()))


def test_looked_up_scores_are_those_of_the_trees(spark, model, monkeypatch):
    bounds = ensemble.cell_bounds(model)
    assert len(bounds) == len(FEATURES) and max(map(len, bounds)) > 2
    rng = random.Random(12)
    rows = list(rows_of(rng, 300))
    # On a bound, next to it, and beyond all of them.
    for feature in (0, 4, 6):
        for b in bounds[feature]:
            for value in (b, math.nextafter(b, math.inf), math.nextafter(b, -math.inf), math.inf, -math.inf):
                row = list(rng.choice(rows[:300]))
                row[feature] = value
                rows.append(tuple(row))
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + SCHEMA)
    plain = scores(ensemble.score(pairs, model))
    assert len({r[1:] for r in plain}) > 20
    assert scores(ensemble.score(pairs, model, many=True)) == plain
    # Columns of an earlier score are replaced.
    assert scores(ensemble.score(ensemble.score(pairs, model), model, many=True)) == plain
    monkeypatch.setattr(ensemble, "CELLS", 1)
    assert ensemble.cell_bounds(model) is None
    assert scores(ensemble.score(pairs, model, many=True)) == plain


@pytest.mark.parametrize("value", [None, math.nan])
def test_pairs_without_a_feature_are_refused(spark, model, value):
    row = list(next(rows_of(random.Random(1), 1)))
    row[4] = value
    pairs = spark.createDataFrame([tuple(row)], SCHEMA)
    for many in (False, True):
        with pytest.raises(Exception, match="(?i)null|nan"):
            ensemble.score(pairs, model, many=many).collect()


def test_features_left_out_and_features_without_a_split(spark):
    kept = ["similarity", "area_match", "age_difference"]
    pairs = spark.createDataFrame([(i, i / 60, 1, 3.0, i // 30) for i in range(60)], "id int, similarity double, area_match int, age_difference double, label int")
    small = ensemble.train(pairs, kept, trees=2)
    assert ensemble.cell_bounds(small)[1:] == [[], []]
    assert scores(ensemble.score(pairs, small, many=True)) == scores(ensemble.score(pairs, small))


def all_cases(make_cases):
    rng = random.Random(5)
    texts = ["gun car", "gun", "knife car", "knife street", "west", ""]
    return make_cases(
        *[
            {"dr_no": i, "mo_text": rng.choice(texts), "area_name": rng.choice("AB"), "crm_cd": rng.randint(1, 3), "weapon_desc": rng.choice(["W", None]),
             "vict_age": rng.choice([20, 35, None]), "vict_sex": rng.choice("FM"), "datetime": datetime(2024, rng.randint(1, 12), 3)}
            for i in range(80)
        ]
    )


@pytest.mark.parametrize("listed", [similarity.LISTED, 0])
def test_rankings_of_all_cases_show_the_trees_cells_and_no_pairs(spark, model, make_cases, tmp_path, monkeypatch, listed):
    cases = all_cases(make_cases)
    index = text_index.load_or_fit(cases, str(tmp_path))
    plain = ensemble.rank_cases(similarity.similar_cases(index, cases, ensemble.served_pool(5), bases_are_all=True), model, 5)
    monkeypatch.setattr(similarity, "LISTED", listed)
    seen = []
    through = ensemble._probabilities
    monkeypatch.setattr(ensemble, "_probabilities", lambda rows, m: seen.append(rows.count()) or through(rows, m))
    ranked = ensemble.rank_all_cases(index, cases, model, 5)
    assert seen == [math.prod(len(b) + 1 for b in ensemble.cell_bounds(model))]
    flat = lambda df: sorted(map(tuple, ensemble.as_served(df).select("q_id", "rank", "dr_no", "area_name", "datetime", "mo_text", F.round("similarity", 9), "score", F.to_json("features")).collect()))
    assert len(flat(ranked)) == 80 * 5 and flat(ranked) == flat(plain)
    assert set(CASE_COLUMNS) == set(ranked.select("cand.*").columns)


@pytest.mark.parametrize("name", ["score_pairs", "ranked_cases"])
def test_cases_are_joined_once(spark, model, monkeypatch, name):
    monkeypatch.setattr(catalog, "_keyed_documents", lambda *_: None)
    monkeypatch.setattr(catalog, "_trained", lambda *_: model)
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "BroadcastHashJoin [_cell" in plan
